"""Corpus statistics, extract building, profiling and redaction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.bindings import (
    EVENT_CALL_SQL,
    STAR_CALL_SQL,
    STAR_PRICING_SQL,
    STAR_SESSION_SQL,
    event_calls,
    star_calls,
    star_pricing,
    star_sessions,
    table,
)
from tracewell.catalog.conversation_binding import TURN_SQL, turn_records
from tracewell.catalog.metric_queries import rounded
from tracewell.catalog.registry import query
from tracewell.functions import paths, redact
from tracewell.functions.measures import is_error, sha1_mod
from tracewell.operators import corpus as C
from tracewell.operators import profile as P
from tracewell.operators import store as K
from tracewell.schemas import SESSION_KEY
from tracewell.sources.lookup import keyed_lookup

# ------------------------------------------------------------- extract building

# sha1(key) modulo 7 from its hex digits: 16**k mod 7 cycles through 1, 2, 4.
_SHA_MOD_7 = """(SELECT sum((position(substr(h, 41 - i, 1) IN '0123456789abcdef') - 1)
    * CASE (i - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END)
  FROM (SELECT sha1(CAST(doc_id AS VARCHAR)) AS h), range(1, 41) r(i)) % 7"""


@query(
    "a1_hash_remainders",
    f"SELECT doc_id, CAST({_SHA_MOD_7} AS BIGINT) AS remainder FROM documents",
)
def a1_hash_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", sha1_mod(key, 7).alias("remainder")
    )


@query("a1_hash_sample", f"SELECT doc_id, lang FROM documents WHERE {_SHA_MOD_7} = 0")
def a1_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample by key hash is the operator itself."""
    return C.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "lang")


@query(
    "a2_cap_by_id",
    """SELECT doc_id, lang, quality FROM (
  SELECT d.doc_id, lang, quality,
    row_number() OVER (PARTITION BY coalesce(CAST(quality AS VARCHAR), '?')
                       ORDER BY CAST(d.doc_id AS VARCHAR)) AS rn
  FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE rn <= 20""",
)
def a2_cap_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap per group is the operator itself; unlabelled documents form a group."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    grouped = joined.withColumn("group", F.col("quality").cast("string"))
    order = [F.col("doc_id").cast("string")]
    return C.cap_per_group(grouped, "group", order, 20).select("doc_id", "lang", "quality")


@query(
    "a2_cap_by_first_appearance",
    f"""WITH {EVENT_CALL_SQL},
f AS (SELECT source_name, external_id, min(record_index) AS first_seen
      FROM event_call GROUP BY 1, 2)
SELECT source_name, external_id, first_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY first_seen) AS rn FROM f)
WHERE rn <= 1200""",
)
def a2_cap_by_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap above the pruning threshold, so groups are split before they are cut."""
    calls = event_calls(spark, sf_dir, numbered=False)
    seen = C.first_seen(calls, "external_id", "source_name", "record_index")
    return C.cap_per_group(seen, "source_name", [F.col("first_seen")], 1200)


@query(
    "a3_whole_entities",
    f"""WITH {TURN_SQL},
chosen AS (SELECT sid FROM turn_rec GROUP BY sid HAVING count(*) FILTER (WHERE role = 'system') > 0)
SELECT sid, turn, role FROM turn_rec WHERE sid IN (SELECT sid FROM chosen)""",
)
def a3_whole_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("sid"), "turn", "role"
    )
    return C.keep_entities(turns, turns.where("role = 'system'"), ["sid"])


@query(
    "a4_degenerate_entities",
    f"""WITH {STAR_SESSION_SQL},
{STAR_CALL_SQL},
a AS (SELECT DISTINCT source_name, external_id FROM star_call)
SELECT agent_name, count(*) FILTER (WHERE a.external_id IS NOT NULL) AS n_active,
  count(*) FILTER (WHERE a.external_id IS NULL) AS n_dropped
FROM star_session s LEFT JOIN a USING (source_name, external_id) GROUP BY 1""",
)
def a4_degenerate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = C.split_degenerate(
        star_sessions(spark, sf_dir), star_calls(spark, sf_dir), SESSION_KEY
    )
    tagged = kept.select("agent_name", F.lit(1).alias("active")).union(
        dropped.select("agent_name", F.lit(0))
    )
    return tagged.groupBy("agent_name").agg(
        F.count_if(F.col("active") == 1).alias("n_active"),
        F.count_if(F.col("active") == 0).alias("n_dropped"),
    )


@query(
    "a5_denormalise",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_orderpriority,
  c_mktsegment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def a5_denormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    sessions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    repositories = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    joined = C.denormalise(turns, sessions, repositories, "l_orderkey", "o_custkey")
    return joined.drop("o_custkey").sortWithinPartitions("l_orderkey", "l_linenumber")


@query(
    "a6_extract_report",
    f"""WITH {TURN_SQL},
n AS (SELECT record_index, count(*) AS n_tools FROM part_row GROUP BY 1),
kept AS (SELECT * FROM turn_rec JOIN n USING (record_index) WHERE role <> 'system')
SELECT role AS provider, count(DISTINCT sid) AS sessions, count(*) AS rounds,
  CAST(sum(n_tools) AS BIGINT) AS tool_records,
  (SELECT count(*) FROM turn_rec) AS rows_scanned
FROM kept GROUP BY 1""",
)
def a6_extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.col("role").alias("provider"),
        F.size(F.split("text", "\n")).alias("n_tools"),
    )
    kept = rows.where("provider <> 'system'")
    return C.extract_report(rows, kept, "provider", "conv_id")


@query(
    "a6_distinct_models",
    f"""WITH {TURN_SQL}
SELECT count(DISTINCT coalesce(engine, '?')) AS distinct_models FROM turn_rec""",
)
def a6_distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = turn_records(spark, sf_dir).select(
        paths.as_text(paths.path(F.col("payload"), "engine")).alias("engine")
    )
    return C.distinct_with_unknown(engines, "engine", "distinct_models")


@query(
    "a6_distinct_users",
    """SELECT count(DISTINCT o_custkey) AS distinct_users FROM orders
WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')""",
)
def a6_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two priorities carry an empty user and none; neither is counted."""
    level = F.col("o_orderpriority")
    user = F.when(level == "5-LOW", "").when(
        level != "4-NOT SPECIFIED", F.col("o_custkey").cast("string")
    )
    sessions = table(spark, sf_dir, "orders").select(user.alias("user_id"))
    return C.distinct_present(sessions, "user_id", "distinct_users")


# ------------------------------------------------------------ corpus statistics

_PARTS = """rounds AS (
  SELECT p_type AS provider, CAST(l_orderkey AS VARCHAR) AS session_id,
    CAST(l_quantity * 100 AS BIGINT) AS input_tokens, CAST(l_quantity AS BIGINT) AS output_tokens,
    CAST(l_quantity * 60 AS BIGINT) AS cache_read, CAST(l_quantity * 30 AS BIGINT) AS cache_created,
    CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity * 10 AS BIGINT) END AS uncached
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    def tokens(factor: int):
        return (F.col("l_quantity") * factor).cast("long")

    return lines.select(
        F.col("p_type").alias("provider"),
        F.col("l_orderkey").cast("string").alias("session_id"),
        tokens(100).alias("input_tokens"),
        tokens(1).alias("output_tokens"),
        tokens(60).alias("cache_read"),
        tokens(30).alias("cache_created"),
        F.when(F.col("l_returnflag") == "A", tokens(10)).alias("uncached"),
    )


_TOKENS = ["input_tokens", "output_tokens", "cache_read", "cache_created", "uncached"]
_TOKEN_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _TOKENS)


@query(
    "a7_token_sums",
    f"WITH {_PARTS}\nSELECT provider, count(*) AS rounds, {_TOKEN_SUMS} FROM rounds GROUP BY 1",
)
def a7_token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_sums(_rounds(spark, sf_dir), "provider", _TOKENS)


@query(
    "a8_composition",
    f"""WITH {_PARTS},
s AS (SELECT provider, {_TOKEN_SUMS} FROM rounds GROUP BY 1)
SELECT provider,
  round(CAST(cache_read AS DOUBLE) / input_tokens, 6) AS cache_read_share,
  round(CAST(cache_created AS DOUBLE) / input_tokens, 6) AS cache_created_share,
  round(CAST(uncached AS DOUBLE) / input_tokens, 6) AS uncached_share,
  cache_read + cache_created + coalesce(uncached, 0) = input_tokens AS is_balanced FROM s""",
)
def a8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.token_sums(_rounds(spark, sf_dir), "provider", _TOKENS)
    parts = ["cache_read", "cache_created", "uncached"]
    shares = [f"{p}_share" for p in parts]
    composed = C.composition(sums, parts, "input_tokens")
    return rounded(composed.select("provider", *shares, "is_balanced"), *shares)


@query(
    "a9_cache_reading_rounds",
    f"""WITH {STAR_CALL_SQL}
SELECT count(*) FILTER (WHERE cached_tokens > 0) AS reading_rounds, count(*) AS rounds,
  round(CAST(count(*) FILTER (WHERE cached_tokens > 0) AS DOUBLE) / count(*), 6) AS share
FROM star_call""",
)
def a9_cache_reading_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.cache_reading_rounds(star_calls(spark, sf_dir), "cached_tokens"), "share")


@query(
    "a10_input_output_ratio",
    f"""WITH {_PARTS}
SELECT provider, CAST(grouping(provider) AS INTEGER) AS is_total,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(CAST(sum(input_tokens) AS DOUBLE) / sum(output_tokens), 6) AS in_out_ratio
FROM rounds GROUP BY ROLLUP (provider)""",
)
def a10_input_output_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = C.input_output_ratio(
        _rounds(spark, sf_dir), "provider", "input_tokens", "output_tokens"
    )
    return rounded(ratios.withColumn("is_total", F.col("is_total").cast("int")), "in_out_ratio")


@query(
    "a11_covered_period",
    f"""WITH {EVENT_CALL_SQL}
SELECT least(min(started_at), min(ended_at)) AS first_seen,
  greatest(max(started_at), max(ended_at)) AS last_seen FROM event_call""",
)
def a11_covered_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = F.array("started_at", "ended_at")
    return C.covered_period(event_calls(spark, sf_dir, numbered=False), stamps)


_ERRORS = "count(*) FILTER (WHERE status IN ('error', 'timeout'))"


@query(
    "a12_tool_errors",
    f"""WITH {EVENT_CALL_SQL}
SELECT tool_name, count(*) AS n_calls, {_ERRORS} AS n_errors,
  round(CAST({_ERRORS} AS DOUBLE) / count(*), 6) AS error_rate
FROM event_call GROUP BY 1 HAVING count(*) >= 100""",
)
def a12_tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = event_calls(spark, sf_dir, numbered=False)
    return rounded(C.tool_error_table(calls, ["tool_name"], is_error(F.col("status"))), "error_rate")


@query(
    "a12_tool_errors_by_source",
    f"""WITH {EVENT_CALL_SQL}
SELECT source_name, count(*) AS n_calls, {_ERRORS} AS n_errors,
  round(CAST({_ERRORS} AS DOUBLE) / count(*), 6) AS error_rate FROM event_call GROUP BY 1""",
)
def a12_tool_errors_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = event_calls(spark, sf_dir, numbered=False)
    by_source = C.tool_error_table(calls, ["source_name"], is_error(F.col("status")), 0)
    return rounded(by_source, "error_rate")


@query(
    "a13_rounds_distribution",
    f"""WITH {STAR_CALL_SQL},
n AS (SELECT source_name, external_id, count(*) AS n FROM star_call GROUP BY 1, 2),
r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS pos, count(*) OVER () AS total FROM n)
SELECT count(*) AS sessions, min(n) AS min_rounds, CAST(median(n) AS DOUBLE) AS median_rounds,
  round(avg(n), 6) AS mean_rounds,
  max(n) FILTER (WHERE pos = greatest(0, CAST(floor(0.9 * total) AS BIGINT) - 1)) AS p90_rounds,
  max(n) AS max_rounds FROM r""",
)
def a13_rounds_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = C.rounds_distribution(star_calls(spark, sf_dir), SESSION_KEY)
    return rounded(spread, "mean_rounds")


# ------------------------------------------------------- profiling and redaction


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label, as typed records in file order."""
    docs = table(spark, sf_dir, "documents", "_metadata.row_index")
    labels = table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    payload = F.to_variant_object(
        F.struct(
            "doc_id",
            "text",
            F.struct("lang", "source", F.struct("quality", "toxic").alias("label")).alias("meta"),
            (F.col("n_chars") / 10).alias("tenths"),
            F.array("lang", "source").alias("tags"),
        )
    )
    return joined.select(
        F.lit("documents").alias("file_key"),
        F.col("row_index").alias("record_index"),
        payload.alias("payload"),
        F.lit(None).cast("string").alias("parse_error"),
    )


# The masked families, written out so that SQL does not lean on the operator.
_MASKED = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"(?i)\b(?:bearer\s+)?(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{12,})\b",
    r"(?i)\b(?:api[_ -]?key|access[_ -]?token|secret|password)\s*[:=]\s*[^\s,;]+",
    r"(?:[A-Za-z]:\\Users\\[^\\\s]+|/home/[^/\s]+|/Users/[^/\s]+)",
)


def _redacted_sql(column: str) -> str:
    text = column
    for pattern in _MASKED:
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED]', 'g')"
    return text


_LEAVES = f"""leaf AS (
  SELECT doc_id AS record_index, 'doc_id' AS path, 'int' AS kind, CAST(doc_id AS VARCHAR) AS v
  FROM documents
  UNION ALL SELECT doc_id, 'text', 'string', {_redacted_sql('text')} FROM documents
  UNION ALL SELECT doc_id, 'meta.lang', 'string', {_redacted_sql('lang')} FROM documents
  UNION ALL SELECT doc_id, 'meta.source', 'string', {_redacted_sql('source')} FROM documents
  UNION ALL SELECT doc_id, 'meta.label.quality', 'int', CAST(quality AS VARCHAR)
    FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 'meta.label.toxic', 'int', CAST(toxic AS VARCHAR)
    FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 'tenths', 'float', CAST(n_chars AS VARCHAR) FROM documents
  UNION ALL SELECT doc_id, 'tags', 'array', '["' || lang || '","' || source || '"]'
    FROM documents)"""


@query(
    "p1_flatten_paths",
    f"WITH {_LEAVES}\nSELECT path, count(*) AS n, count(v) AS filled FROM leaf GROUP BY 1",
)
def p1_flatten_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = P.flatten_paths(document_records(spark, sf_dir))
    return leaves.groupBy("path").agg(
        F.count("*").alias("n"), F.count_if(~F.is_variant_null("leaf")).alias("filled")
    )


@query(
    "p2_p4_profile",
    f"""WITH {_LEAVES}
SELECT path, CASE WHEN count(v) = 0 THEN 'null' ELSE min(kind) END AS inferred_type,
  round(1.0 - CAST(count(v) AS DOUBLE) / count(*), 6) AS null_ratio,
  count(DISTINCT v) AS distinct_count
FROM leaf GROUP BY 1""",
)
def p2_p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = P.profile(document_records(spark, sf_dir), sample_size=0)
    return rounded(described.drop("file_key", "sample_values"), "null_ratio")


@query(
    "p3_null_ratio_since_first",
    """SELECT CAST((count(*) - count(quality)) AS DOUBLE) / count(*) AS null_ratio
FROM documents LEFT JOIN labels USING (doc_id)
WHERE doc_id >= (SELECT min(doc_id) FROM documents WHERE lang = 'fr')""".replace(
        "CAST((count(*) - count(quality)) AS DOUBLE) / count(*)",
        "round(CAST((count(*) - count(quality)) AS DOUBLE) / count(*), 6)",
    ),
)
def p3_null_ratio_since_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that appears first with the first French document; labels are often absent."""
    docs = table(spark, sf_dir, "documents", "_metadata.row_index")
    first = docs.where("lang = 'fr'").agg(F.min("row_index").alias("f")).scalar()
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("f", first)
    entries = F.when(F.col("row_index") == F.col("f"), F.to_json(F.struct("quality"),
                                                                {"ignoreNullFields": "false"}))
    later = F.when(F.col("quality").isNotNull(), F.to_json(F.struct("quality")))
    records = joined.select(
        F.lit("documents").alias("file_key"),
        F.col("row_index").alias("record_index"),
        F.parse_json(
            F.coalesce(F.when(F.col("row_index") > F.col("f"), later), entries, F.lit("{}"))
        ).alias("payload"),
        F.lit(None).cast("string").alias("parse_error"),
    )
    return rounded(P.profile(records, sample_size=0).select("null_ratio"), "null_ratio")


@query(
    "p5_sample_values",
    f"""WITH {_LEAVES},
f AS (SELECT path, v, min(record_index) AS first FROM leaf
      WHERE v IS NOT NULL AND path <> 'tenths' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first) AS rn FROM f)
SELECT path, string_agg(v, '|' ORDER BY first) AS samples FROM r WHERE rn <= 3 GROUP BY 1""",
)
def p5_sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = P.profile(document_records(spark, sf_dir), sample_size=3)
    joined = F.concat_ws("|", "sample_values").alias("samples")
    return described.where("path <> 'tenths'").select("path", joined)


@query("p6_record_count", "SELECT count(*) AS record_count FROM documents")
def p6_record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.record_counts(document_records(spark, sf_dir)).select("record_count")


@query(
    "p7_redact",
    f"""SELECT doc_id, md5({_redacted_sql('text')}) AS digest,
  {_redacted_sql('text')} <> text AS is_changed FROM documents""",
)
def p7_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = redact.redact_columns(docs.withColumn("clean", F.col("text")), "clean")
    return clean.select(
        "doc_id",
        F.md5(F.col("clean").cast("binary")).alias("digest"),
        (F.col("clean") != F.col("text")).alias("is_changed"),
    )


@query(
    "p8_sample_records",
    f"""SELECT doc_id AS record_index, {_redacted_sql('text')} AS text, source
FROM documents ORDER BY doc_id LIMIT 20""",
)
def p8_sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 records are the feature: a redacted excerpt of an unknown file."""
    shown = P.sample_records(document_records(spark, sf_dir), 20)
    return shown.select(
        "record_index",
        F.get_json_object("payload_json", "$.text").alias("text"),
        F.get_json_object("payload_json", "$.meta.source").alias("source"),
    )


# --------------------------------------------------- keyed inserts and lookups

_KEY = ["l_orderkey", "l_linenumber"]
_LINES = [*_KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_FIRST_LINE = """row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1"""


@query(
    "k1_insert_ignore",
    f"""WITH target AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
batch AS (SELECT {', '.join(_LINES)} FROM lineitem WHERE l_linestatus = 'O')
SELECT * FROM (SELECT * FROM batch QUALIFY {_FIRST_LINE}) b
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.l_orderkey = b.l_orderkey
                  AND t.l_linenumber = b.l_linenumber)""",
)
def k1_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    batch = lines.where("l_linestatus = 'O'").select(*_LINES)
    order = [F.col(c) for c in _LINES[2:]]
    return K.insert_ignore(lines.where("l_linestatus = 'F'"), batch, _KEY, order)


@query(
    "k2_register_dimension",
    f"""WITH {STAR_SESSION_SQL},
d AS (SELECT DISTINCT source_name, repository_name AS name FROM star_session)
SELECT count(*) AS total, count(*) FILTER (WHERE source_name <> 'src0') AS registered,
  count(*) FILTER (WHERE source_name = 'src0') AS skipped FROM d""",
)
def k2_register_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = K.harvest_repositories(star_sessions(spark, sf_dir))
    known = named.where("source_name = 'src0'")
    return K.register_dimension(known, named, ["source_name", "name"])[1]


@query(
    "k3_upsert_overwrite",
    f"""WITH {STAR_PRICING_SQL}
SELECT model_name,
  CASE WHEN model_name < 'Brand#2' THEN input_usd_per_mtok * 2 ELSE input_usd_per_mtok END
    AS input_usd_per_mtok FROM star_pricing
UNION ALL
SELECT * FROM (SELECT 'new-' || p_brand, CAST(max(p_size) AS DOUBLE) FROM part
  WHERE p_type = 'LARGE' GROUP BY p_brand)""",
)
def k3_upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = star_pricing(spark, sf_dir).select("model_name", "input_usd_per_mtok")
    changed = prices.where("model_name < 'Brand#2'").withColumn(
        "input_usd_per_mtok", F.col("input_usd_per_mtok") * 2
    )
    added = (
        table(spark, sf_dir, "part")
        .where("p_type = 'LARGE'")
        .groupBy(F.concat(F.lit("new-"), "p_brand").alias("model_name"))
        .agg(F.max("p_size").cast("double").alias("input_usd_per_mtok"))
    )
    return K.upsert_overwrite(prices, changed.unionByName(added), ["model_name"])


@query(
    "s10_keyed_lookup",
    """SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (
  SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def s10_keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return keyed_lookup(turns, turns.where("role = 'system'"), "conv_id")


@query(
    "s12_harvest_values",
    f"WITH {TURN_SQL}\nSELECT DISTINCT engine AS value FROM turn_rec WHERE engine <> ''",
)
def s12_harvest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = paths.as_text(paths.path(F.col("payload"), "engine"))
    return K.harvest_values(turn_records(spark, sf_dir), engine)
