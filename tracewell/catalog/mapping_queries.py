"""Mapping application and transforms over conversation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.bindings import STAR_CALL_SQL, STAR_SESSION_SQL, STAR_TOOL_SQL
from tracewell.catalog.bindings import star_calls, star_sessions, star_tools, table
from tracewell.catalog.conversation_binding import (
    DOCUMENT,
    PARENT,
    TURN_SQL,
    repeat_mapping,
    turn_mapping,
    turn_records,
)
from tracewell.catalog.registry import query
from tracewell.functions import paths, transforms
from tracewell.functions.ranking import first_per_key
from tracewell.operators import metrics as M
from tracewell.operators.normalise import (
    backfill_sessions,
    invariant_failure,
    link_model_calls,
    link_repositories,
    link_sessions,
    normalise,
    orphan_calls,
    preview,
)
from tracewell.schemas import SESSION_KEY



def _run(spark: SparkSession, sf_dir: str):
    return normalise(turn_records(spark, sf_dir), turn_mapping())


# ----------------------------------------------------------------------- paths


@query(
    "m1_paths",
    f"""WITH {TURN_SQL},
p AS (SELECT record_index, min_by(part_size, no) AS first_size, max_by(part_size, no) AS last_size,
        max(CASE WHEN no = 2 THEN part_size END) AS third_size
      FROM part_row GROUP BY 1)
SELECT record_index, role, size AS used, first_size, last_size, third_size,
  CAST(NULL AS VARCHAR) AS on_list, CAST(NULL AS VARCHAR) AS on_object
FROM turn_rec JOIN p USING (record_index)""",
)
def m1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(dotted: str) -> Column:
        return transforms.to_long(paths.path(F.col("payload"), dotted))

    def text(dotted: str) -> Column:
        return paths.as_text(paths.path(F.col("payload"), dotted))

    return turn_records(spark, sf_dir).select(
        "record_index",
        text("role").alias("role"),
        number("usage.in").alias("used"),
        number("parts.0.size").alias("first_size"),
        number("parts.-1.size").alias("last_size"),
        number("parts.2.size").alias("third_size"),
        text("parts.size").alias("on_list"),
        text("usage.0").alias("on_object"),
    )


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = paths.rows_at(F.col("payload"), "parts")
    rows = turn_records(spark, sf_dir).select(
        "record_index", "payload", F.posexplode(items).alias("pos", "row")
    )
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(
    "m2_row_then_root",
    f"""WITH {TURN_SQL}
SELECT record_index, no AS pos, part_size AS own, turn AS inherited, label AS null_in_row
FROM part_row""",
)
def m2_row_then_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, root = F.col("row"), F.col("payload")
    return _part_rows(spark, sf_dir).select(
        "record_index",
        "pos",
        transforms.to_long(paths.lookup(row, root, "size")).alias("own"),
        transforms.to_long(paths.lookup(row, root, "turn")).alias("inherited"),
        paths.as_text(paths.lookup(row, root, "label")).alias("null_in_row"),
    )


@query(
    "m3_iterate",
    f"WITH {TURN_SQL}\nSELECT record_index, count(*) AS n, max(no) AS last FROM part_row GROUP BY 1",
)
def m3_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_rows(spark, sf_dir).where(paths.is_object(F.col("row")))
    counted = rows.groupBy("record_index").agg(
        F.count("*").alias("n"), F.max("pos").alias("last")
    )
    return counted


_PREDICATES = {
    "m4_eq": ("label", "eq", "long", "label = 'long'"),
    "m4_eq_number": ("no", "eq", 1.0, "no = 1"),
    "m4_eq_bool": ("ok", "eq", True, "ok"),
    "m4_eq_null": ("label", "eq", None, "label IS NULL"),
    "m5_ne": ("label", "ne", "long", "label IS DISTINCT FROM 'long'"),
    "m6_in": ("no", "in", [0, 2, "x"], "no IN (0, 2)"),
    "m7_exists": ("label", "exists", True, "label IS NOT NULL"),
    "m7_not_exists": ("label", "exists", None, "label IS NULL"),
    "m8_gt": ("size", "gt", 60, "part_size > 60"),
    "m8_lt": ("size", "lt", 30, "part_size < 30"),
    "m8_lt_mismatch": ("size", "lt", "30", "false"),
}


def _predicate(name: str, field: str, op: str, value, sql: str) -> None:
    """Register a query that counts the rows passing one filter, per kind of turn."""

    @query(
        name,
        f"""WITH {TURN_SQL}
SELECT role, count(*) FILTER (WHERE {sql}) AS passing, count(*) AS n_rows
FROM part_row GROUP BY 1""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        role = paths.as_text(paths.path(F.col("payload"), "role")).alias("role")
        passes = paths.matches(F.col("row"), field, op, value)
        return (
            _part_rows(spark, sf_dir)
            .groupBy(role)
            .agg(F.count_if(passes).alias("passing"), F.count("*").alias("n_rows"))
        )


for _name, _spec in _PREDICATES.items():
    _predicate(_name, *_spec)


@query(
    "m9_where",
    f"""WITH {TURN_SQL}
SELECT record_index, no AS pos FROM part_row
WHERE label = 'short' AND no > 0 AND ok AND label IS NOT NULL""",
)
def m9_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, row = _part_rows(spark, sf_dir), F.col("row")
    for clause in (
        ("label", "eq", "short"),
        ("no", "gt", 0),
        ("ok", "eq", True),
        ("label", "exists", True),
    ):
        rows = rows.where(paths.matches(row, *clause))
    return rows.select("record_index", "pos")


# --------------------------------------------------------------- normalisation


@query(
    "m10_model_calls",
    f"""WITH {TURN_SQL}
SELECT 'talks' AS source_name, sid AS external_id, turn AS sequence, engine AS model_name,
  CAST(NULL AS VARCHAR) AS provider, size AS prompt_tokens, size // 4 AS completion_tokens,
  turn * 100 AS cached_tokens, size + size // 4 AS total_tokens, size / 100.0 AS cost_usd,
  said_at AS started_at, said_at AS ended_at, 'success' AS status, CAST(NULL AS VARCHAR) AS error_type,
  record_index
FROM kept_call""".replace("size / 100.0 AS", "CAST(size AS DOUBLE) / 100 AS"),
)
def m10_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).model_calls.drop("file_sha256", "record_sha256")


@query(
    "m16_tool_calls_positional",
    f"""WITH {TURN_SQL}
SELECT 'talks' AS source_name, sid AS external_id, seq AS sequence, label AS tool_name,
  turn AS model_call_sequence, said_at AS started_at, CAST(NULL AS TIMESTAMP) AS ended_at,
  CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
  CASE WHEN NOT ok THEN 'tool_error' END AS error_type, part_size AS input_bytes,
  CAST(NULL AS BIGINT) AS output_bytes, record_index
FROM kept_part""",
)
def m16_tool_calls_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).tool_calls.drop("file_sha256", "record_sha256")


@query(
    "m14_sessions",
    f"""WITH {TURN_SQL},
b AS (SELECT sid, min(said_at) AS lo, max(said_at) AS hi FROM call_time GROUP BY sid)
SELECT 'talks' AS source_name, f.sid AS external_id,
  CASE WHEN f.role = 'user' THEN 'human' ELSE 'machine' END AS agent_name,
  CAST(NULL AS VARCHAR) AS repository_name, b.lo AS started_at, b.hi AS ended_at,
  f.record_index
FROM (SELECT * FROM turn_rec QUALIFY row_number() OVER (PARTITION BY sid ORDER BY record_index) = 1) f
LEFT JOIN b USING (sid)""",
)
def m14_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).sessions.drop("file_sha256", "record_sha256")


@query(
    "m18_rejects",
    f"""WITH {TURN_SQL}
SELECT record_index, call_problem AS reason_code FROM turn_rec WHERE call_problem IS NOT NULL
UNION ALL
SELECT record_index, 'missing_required_field' FROM first_bad""",
)
def m18_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).rejects.select("record_index", "reason_code")


@query(
    "m20_missing_info",
    f"""WITH {TURN_SQL},
f AS (
  SELECT 'tool_call.error_type' AS target, count(*) FILTER (WHERE ok) AS n_missing FROM kept_part
  UNION ALL SELECT 'tool_call.started_at', count(*) FILTER (WHERE said_at IS NULL) FROM kept_part
  UNION ALL SELECT 'session.started_at', count(*) FROM (SELECT DISTINCT sid FROM turn_rec
    WHERE sid NOT IN (SELECT sid FROM call_time WHERE said_at IS NOT NULL))
  UNION ALL SELECT 'session.ended_at', count(*) FROM (SELECT DISTINCT sid FROM turn_rec
    WHERE sid NOT IN (SELECT sid FROM call_time WHERE said_at IS NOT NULL)))
SELECT * FROM f WHERE n_missing > 0""",
)
def m20_missing_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).missing_info.drop("file_sha256")


@query(
    "m15_child_dedup",
    f"""WITH {TURN_SQL},
d AS (SELECT sid, label, part_size, record_index, no FROM part_row WHERE label IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY sid, label ORDER BY record_index, no) = 1)
SELECT sid AS external_id, label AS tool_name, part_size AS input_bytes, record_index,
  row_number() OVER (PARTITION BY sid ORDER BY record_index, no) - 1 AS sequence,
  'unknown' AS status FROM d""",
)
def m15_child_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = normalise(turn_records(spark, sf_dir), repeat_mapping()).tool_calls
    return calls.select(
        "external_id", "tool_name", "input_bytes", "record_index", "sequence", "status"
    )


@query(
    "m11_required_after_fields",
    f"""WITH {TURN_SQL}
SELECT record_index, 'missing_required_field' AS reason_code FROM turn_rec
WHERE role = 'assistant' AND engine IS NULL""",
)
def m11_required_after_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model name that may be NULL as a field still ends the record as an entity."""
    from tracewell.plans.mapping import load_mapping

    call = {
        "iterate": {"path": "", "where": [["role", "eq", "assistant"]]},
        "parent": PARENT,
        "identity": {"key_fields": ["sid", "turn"]},
        "fields": {"model_name": {"from": "engine", "on_error": "null"}},
    }
    entities = {"session": DOCUMENT["entities"]["session"], "model_call": call}
    mapping = load_mapping({**DOCUMENT, "entities": entities})
    rejects = normalise(turn_records(spark, sf_dir), mapping).rejects
    return rejects.select("record_index", "reason_code")


@query(
    "m12_coercion",
    f"""WITH {TURN_SQL}
SELECT record_index, turn AS int_of_number, CAST(NULL AS BIGINT) AS int_of_text,
  CAST(size AS DOUBLE) AS float_of_number, CAST(NULL AS DOUBLE) AS float_of_text,
  said_at AS instant, CAST(NULL AS TIMESTAMP) AS instant_of_number FROM turn_rec""",
)
def m12_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.operators.normalise import _coerce

    def coerced(name: str, expected: str) -> Column:
        source = paths.path(F.col("payload"), name)
        return _coerce(transforms.apply("identity", source), expected)

    return turn_records(spark, sf_dir).select(
        "record_index",
        coerced("turn", "int").alias("int_of_number"),
        coerced("role", "int").alias("int_of_text"),
        coerced("usage.in", "float").alias("float_of_number"),
        coerced("role", "float").alias("float_of_text"),
        coerced("at", "datetime").alias("instant"),
        coerced("turn", "datetime").alias("instant_of_number"),
    )


@query(
    "m13_synthetic_key",
    f"""WITH {TURN_SQL}
SELECT sha1('talks|session|' || sid || '|' || role) AS external_id,
  min(record_index) AS record_index
FROM turn_rec GROUP BY 1""",
)
def m13_synthetic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.plans.mapping import load_mapping

    mapping = load_mapping(
        {
            "name": "derived-ids",
            "version": 1,
            "source_format": "jsonl",
            "constants": {"source_name": "talks"},
            "entities": {
                "session": {
                    "identity": {"key_fields": ["sid", "role"]},
                    "fields": {"agent_name": {"from": "role"}},
                }
            },
        }
    )
    sessions = normalise(turn_records(spark, sf_dir), mapping).sessions
    return sessions.select("external_id", "record_index")


@query(
    "m17_invariants",
    """WITH c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate AS started_at,
    l_shipdate AS ended_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN ended_at < started_at THEN 'schema_violation' END AS reason, count(*) AS n
FROM c GROUP BY 1""",
)
def m17_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem")
    calls = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("tool").alias("tool_name"),
        F.col("o_orderdate").alias("started_at"),
        F.col("l_shipdate").alias("ended_at"),
    )
    broken = invariant_failure("tool_call", {name: name for name in calls.columns}, 0)
    return calls.groupBy(broken["reason"].alias("reason")).agg(F.count("*").alias("n"))


def _rules(name: str, entity: str, sound: dict[str, str], broken: list[tuple[str, dict]]) -> None:
    """Register a query in which row ``k`` of every ``len(broken) + 1`` breaks rule ``k``.

    ``broken`` holds each rule's message and the columns that break it, as SQL expressions.
    """
    turn = "(l_orderkey + l_linenumber)"
    cases = " ".join(f"WHEN {k} THEN '{entity}: {text}'" for k, (text, _) in enumerate(broken))

    @query(
        name,
        f"""SELECT CASE {turn} % {len(broken) + 1} {cases} END AS detail, count(*) AS n
FROM lineitem GROUP BY 1""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = f"{turn} % {len(broken) + 1}"
        columns = {}
        for column, value in sound.items():
            changes = [
                f"WHEN {k} = {i} THEN {change[column]}"
                for i, (_, change) in enumerate(broken)
                if column in change
            ]
            expression = f"CASE {' '.join(changes)} ELSE {value} END" if changes else value
            columns[column] = F.expr(expression).alias(column)
        rows = table(spark, sf_dir, "lineitem").select(*columns.values())
        failure = invariant_failure(entity, {c: c for c in columns}, 0)
        return rows.groupBy(failure["detail"].alias("detail")).agg(F.count("*").alias("n"))


_TIMES = {"started_at": "l_shipdate", "ended_at": "l_shipdate + INTERVAL 1 SECOND"}
_EARLY = ("ended_at precedes started_at", {"ended_at": "l_shipdate - INTERVAL 1 SECOND"})
_OUTCOMES = [
    ("error_type must be absent on success", {"status": "'success'", "error_type": "'late'"}),
    ("error_type is required on error", {"status": "'error'"}),
]


def _negative(*names: str) -> list[tuple[str, dict]]:
    return [(f"{name} is negative", {name: "-1L"}) for name in names]


_rules(
    "m17_session_rules",
    "session",
    {**_TIMES, "external_id": "CAST(l_orderkey AS STRING)"},
    [_EARLY, ("external_id is empty", {"external_id": "'  '"})],
)
_rules(
    "m17_model_call_rules",
    "model_call",
    {
        **_TIMES,
        "prompt_tokens": "CAST(l_quantity AS BIGINT)",
        "completion_tokens": "CAST(l_quantity AS BIGINT)",
        "cached_tokens": "0L",
        "model_name": "'m'",
        "sequence": "CAST(l_linenumber AS BIGINT)",
        "cost_usd": "CAST(l_tax AS DOUBLE)",
        "status": "'unknown'",
        "error_type": "CAST(NULL AS STRING)",
    },
    [
        _EARLY,
        *_negative("prompt_tokens", "completion_tokens", "cached_tokens"),
        ("cached_tokens exceeds prompt_tokens", {"cached_tokens": "CAST(l_quantity AS BIGINT) + 1"}),
        ("model_name is empty", {"model_name": "''"}),
        *_negative("sequence"),
        ("cost_usd is negative", {"cost_usd": "-0.5D"}),
        *_OUTCOMES,
    ],
)
_rules(
    "m17_tool_call_rules",
    "tool_call",
    {
        **_TIMES,
        "tool_name": "'t'",
        "sequence": "CAST(l_linenumber AS BIGINT)",
        "model_call_sequence": "CAST(l_linenumber AS BIGINT)",
        "input_bytes": "CAST(l_quantity AS BIGINT)",
        "output_bytes": "0L",
        "status": "'unknown'",
        "error_type": "CAST(NULL AS STRING)",
    },
    [
        _EARLY,
        ("tool_name is empty", {"tool_name": "' '"}),
        *_negative("sequence", "model_call_sequence", "input_bytes", "output_bytes"),
        *_OUTCOMES,
    ],
)


@query(
    "m19_parse_errors",
    f"""WITH {TURN_SQL}
SELECT record_index, 'unparseable_record' AS reason_code FROM turn_rec WHERE role = 'system'""",
)
def m19_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns arrive cut off, so their lines cannot be read."""
    records = turn_records(spark, sf_dir)
    cut = paths.as_text(paths.path(F.col("payload"), "role")) == "system"
    broken = records.withColumns(
        {
            "parse_error": F.when(cut, F.lit("invalid JSON")),
            "payload": F.when(~cut, F.col("payload")),
        }
    )
    rejects = normalise(broken, repeat_mapping()).rejects
    return rejects.select("record_index", "reason_code")


@query(
    "m21_backfill",
    f"""WITH {STAR_SESSION_SQL},
{STAR_CALL_SQL},
b AS (SELECT source_name, external_id, min(least(started_at, ended_at)) AS lo,
        max(greatest(started_at, ended_at)) AS hi FROM star_call GROUP BY 1, 2),
j AS (SELECT s.*, coalesce(s.started_at, lo) AS st, coalesce(s.ended_at, hi) AS en
      FROM star_session s LEFT JOIN b USING (source_name, external_id))
SELECT source_name, external_id,
  CASE WHEN coalesce(en < st, false) THEN started_at ELSE st END AS started_at,
  CASE WHEN coalesce(en < st, false) THEN ended_at ELSE en END AS ended_at FROM j""",
)
def m21_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = star_sessions(spark, sf_dir)
    filled = backfill_sessions(sessions, star_calls(spark, sf_dir), SESSION_KEY)
    return filled.select(*SESSION_KEY, "started_at", "ended_at")


@query(
    "m23_provenance_columns",
    f"""WITH {TURN_SQL}
SELECT 'talks' AS source_name, engine AS model_name, min(record_index) AS first_record,
  count(*) AS n, count(*) AS with_fingerprint FROM kept_call GROUP BY 2""",
)
def m23_provenance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _run(spark, sf_dir).model_calls
    return calls.groupBy("source_name", "model_name").agg(
        F.min("record_index").alias("first_record"),
        F.count("*").alias("n"),
        F.count_if(F.length("record_sha256") == 64).alias("with_fingerprint"),
    )


@query(
    "m24_default_status",
    f"""WITH {TURN_SQL}
SELECT 'unknown' AS status, count(DISTINCT (sid, label)) AS n FROM part_row
WHERE label IS NOT NULL""",
)
def m24_default_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = normalise(turn_records(spark, sf_dir), repeat_mapping()).tool_calls
    return calls.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "m25_link_repositories",
    f"""WITH {STAR_SESSION_SQL},
known AS (SELECT DISTINCT source_name, repository_name AS name FROM star_session
          WHERE source_name IN ('src0', 'src1') AND repository_name <> 'BUILDING')
SELECT s.source_name, s.external_id, k.name AS repository_name
FROM star_session s LEFT JOIN known k
  ON k.source_name = s.source_name AND k.name = s.repository_name""",
)
def m25_link_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.operators.store import harvest_repositories

    sessions = star_sessions(spark, sf_dir)
    known = harvest_repositories(sessions).where(
        "source_name IN ('src0', 'src1') AND name <> 'BUILDING'"
    )
    return link_repositories(sessions, known).select(*SESSION_KEY, "repository_name")


@query(
    "m26_link_sessions",
    f"""WITH {STAR_SESSION_SQL},
{STAR_CALL_SQL},
timed AS (SELECT * FROM star_session WHERE started_at IS NOT NULL)
SELECT c.model_name, count(t.external_id) AS n_linked,
  count(DISTINCT CASE WHEN t.external_id IS NULL THEN c.external_id END) AS n_orphan_sessions
FROM star_call c LEFT JOIN timed t USING (source_name, external_id) GROUP BY 1""",
)
def m26_link_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = star_sessions(spark, sf_dir).where("started_at IS NOT NULL")
    calls = star_calls(spark, sf_dir)
    keys = ["model_name", *SESSION_KEY]
    linked = link_sessions(calls, timed, SESSION_KEY).groupBy("model_name").agg(
        F.count("*").alias("n_linked")
    )
    orphans = calls.select(*keys).distinct().join(
        orphan_calls(calls, timed, SESSION_KEY), SESSION_KEY
    )
    lost = orphans.groupBy("model_name").agg(F.count("*").alias("n_orphan_sessions"))
    zero = F.lit(0).cast("long")
    return linked.join(lost, "model_name", "full").select(
        "model_name",
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.coalesce("n_orphan_sessions", zero).alias("n_orphan_sessions"),
    )


_CALL_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]


@query(
    "m27_link_model_calls",
    f"""WITH {STAR_CALL_SQL},
{STAR_TOOL_SQL},
good AS (SELECT DISTINCT source_name, external_id, sequence FROM star_call
         WHERE status = 'success')
SELECT t.tool_name, g.sequence IS NOT NULL AS has_model_call, count(*) AS n
FROM star_tool t LEFT JOIN good g ON g.source_name = t.source_name
  AND g.external_id = t.external_id AND g.sequence = t.model_call_sequence GROUP BY 1, 2""",
)
def m27_link_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = star_calls(spark, sf_dir).where("status = 'success'")
    unique = first_per_key(
        calls, [*SESSION_KEY, "sequence"], [F.col(c) for c in _CALL_ORDER]
    )
    linked = link_model_calls(star_tools(spark, sf_dir), unique, SESSION_KEY)
    return linked.groupBy("tool_name", "has_model_call").agg(F.count("*").alias("n"))


@query(
    "m28_preview",
    f"""WITH {TURN_SQL}
SELECT * FROM (
SELECT 'session' AS entity, count(DISTINCT sid) AS n FROM turn_rec WHERE record_index < 50
UNION ALL SELECT 'model_call', count(*) FROM kept_call WHERE record_index < 50
UNION ALL SELECT 'tool_call', count(*) FROM kept_part WHERE record_index < 50
UNION ALL SELECT 'reject', (SELECT count(*) FROM turn_rec
    WHERE call_problem IS NOT NULL AND record_index < 50)
  + (SELECT count(*) FROM first_bad WHERE record_index < 50)) WHERE n > 0""",
)
def m28_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50-record preview is the feature; its limit is the user's."""
    shown = preview(turn_records(spark, sf_dir), turn_mapping(), 50)
    parts = {
        "session": shown.sessions,
        "model_call": shown.model_calls,
        "tool_call": shown.tool_calls,
        "reject": shown.rejects,
    }
    tagged = [df.select(F.lit(name).alias("entity")) for name, df in parts.items()]
    union = tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])
    return union.groupBy("entity").agg(F.count("*").alias("n"))


@query(
    "q23_provenance",
    f"""WITH {TURN_SQL}
SELECT sid AS external_id, turn AS sequence, record_index, role AS raw_role FROM kept_call""",
)
def q23_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = turn_records(spark, sf_dir)
    calls = normalise(records, turn_mapping()).model_calls.drop("record_sha256")
    raw = records.select(
        F.col("file_key").alias("file_sha256"),
        "record_index",
        "record_sha256",
        F.to_json("payload").alias("payload_json"),
    )
    return M.provenance(calls, raw).select(
        "external_id",
        "sequence",
        "record_index",
        F.get_json_object("payload_json", "$.role").alias("raw_role"),
    )


# ------------------------------------------------------------------ transforms


def _transform(
    name: str, source: str | None, args: dict, kind: str, sql: str, failed: str = "false"
) -> None:
    """Register a query that applies one transform to every record."""

    @query(
        name,
        f"""WITH {TURN_SQL}
SELECT record_index, {sql} AS value, {failed} AS failed FROM turn_rec""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = F.col("payload")
        found = paths.path(root, source) if source else F.lit(None).cast("variant")
        cell = transforms.apply(name.split("_", 1)[1], found, args, root)
        value = cell.value
        if cell.type == "variant":
            value = paths.as_text(value) if kind == "text" else transforms.to_long(value)
        return turn_records(spark, sf_dir).select(
            "record_index", value.alias("value"), cell.failed.alias("failed")
        )


_transform("f1_identity", "role", {}, "text", "role")
_transform("f2_to_int", "code", {}, "long",
           "CASE WHEN size % 4 = 0 THEN CAST(turn AS BIGINT) END", "size % 4 <> 0")
_transform("f3_to_float", "code", {}, "double",
           "CASE size % 4 WHEN 0 THEN CAST(turn AS DOUBLE) WHEN 2 THEN turn + CAST(0.5 AS DOUBLE) END",
           "size % 4 NOT IN (0, 2)")
_transform(
    "f4_to_iso8601",
    "usage.in",
    {"unit": "epoch_s"},
    "timestamp",
    "TIMESTAMP '1970-01-01' + to_seconds(size)",
)
_transform("f5_lower", "title", {}, "text", "role")
_transform("f6_upper", "role", {}, "text", "upper(role)")
_transform("f7_trim", "padded", {}, "text", "role")
_transform(
    "f8_json_stringify",
    "usage",
    {},
    "text",
    """'{"cached":' || (turn * 100) || ',"in":' || size || ',"out":' || (size // 4) || '}'""",
)
_transform("f9_const", None, {"value": "fixed"}, "text", "'fixed'")
_transform("f10_coalesce", None, {"fields": ["none", "engine", "role"]}, "text",
           "coalesce(engine, role)")
_transform(
    "f11_map_enum",
    "role",
    {"mapping": {"user": "u", "system": "s"}, "default": "other"},
    "text",
    "CASE role WHEN 'user' THEN 'u' WHEN 'system' THEN 's' ELSE 'other' END",
)
_transform("f12_split", "trail", {"sep": "/", "index": -2}, "text", "role")
_transform(
    "f13_regex_extract",
    "tag",
    {"pattern": "run-(?P<n>[0-9]+)", "group": "n"},
    "text",
    "CASE WHEN turn > 2 THEN CAST(turn AS VARCHAR) END",
)
_transform("f14_cents_to_usd", "usage.in", {}, "double", "CAST(size AS DOUBLE) / 100")
_transform("f15_ms_to_s", "ms", {}, "double", "CAST(turn * 1500 AS DOUBLE) / 1000")
