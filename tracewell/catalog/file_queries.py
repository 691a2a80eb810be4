"""Sources, sinks and whole imports over files that Spark writes from the driver tables.

The files go to the folder the session names for checkpoints. They hold every row of their
table; nothing is sampled.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.bindings import STAR_PRICING_SQL, star_pricing, table
from tracewell.catalog.conversation_binding import DOCUMENT, TURN_SQL, turn_line
from tracewell.catalog.registry import query
from tracewell.cluster import scratch_path
from tracewell.operators.ingest import TABLES, Warehouse, ingest, total_report
from tracewell.operators.profile import profile
from tracewell.operators.store import export_jsonl
from tracewell.plans.mapping import Mapping, load_mapping
from tracewell.sources.files import file_fingerprints, list_files
from tracewell.sources.lookup import read_prices
from tracewell.sources.readers import read_any, read_csv, read_jsonl, read_parquet
from tracewell.streaming.ingest import ingest_stream

# ----------------------------------------------------------------------- scans


def delivered_lines(
    spark: SparkSession, sf_dir: str, some: DataFrame | None = None
) -> DataFrame:
    """A JSON line per turn: system turns are cut off, short user turns are blank lines."""
    turns = table(spark, sf_dir, "conversations") if some is None else some
    line = turn_line()
    damaged = (
        F.when(F.col("role") == "system", F.substring(line, F.lit(1), F.length(line) - 1))
        .when((F.col("role") == "user") & (F.length("text") < 60), F.lit(""))
        .otherwise(line)
    )
    return turns.select(damaged.alias("value"), "role")


# `problem` is the parse error of a delivered line.
DELIVERED_SQL = (
    TURN_SQL
    + """,
delivered AS (SELECT *, CASE WHEN role = 'system' THEN 'invalid JSON'
    WHEN role = 'user' AND size < 60 THEN 'empty JSONL line' END AS problem FROM turn_rec)"""
)


def _written(lines: DataFrame, label: str, **options: str) -> str:
    """A fresh folder of text files holding the lines."""
    path = scratch_path(lines.sparkSession, label)
    lines.select("value").write.options(**options).text(path)
    return path


@query(
    "s1_read_jsonl",
    f"WITH {DELIVERED_SQL}\nSELECT problem AS parse_error, count(*) AS n FROM delivered GROUP BY 1",
)
def s1_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_jsonl(spark, [_written(delivered_lines(spark, sf_dir), "lines")])
    return raw.groupBy("parse_error").agg(F.count("*").alias("n"))


@query(
    "s2_read_csv",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars,
  'a "quoted", text' AS note FROM documents""",
)
def s2_read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    columns = ["doc_id", "lang", "source", "n_chars"]
    docs = table(spark, sf_dir, "documents").select(
        *columns, F.lit('a "quoted", text').alias("note")
    )
    docs.write.option("header", "true").option("escape", '"').csv(path)
    raw = read_csv(spark, [path])
    return raw.select(
        *[F.variant_get("payload", f"$.{c}", "string").alias(c) for c in [*columns, "note"]]
    )


@query(
    "s2_csv_odd_rows",
    """WITH c AS (
  SELECT c_nationkey, c_custkey, c_nationkey % 2 = 0 AS wide, c_custkey % 5 AS k,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS record_index
  FROM customer)
SELECT 'c_nationkey=' || c_nationkey AS folder, record_index,
  CASE WHEN k < 3 THEN CAST(c_custkey AS VARCHAR) END AS id,
  CASE WHEN k < 3 AND wide THEN 'm' END AS mark,
  CASE k WHEN 0 THEN 'say "hi", now' WHEN 1 THEN '5" wide' WHEN 2 THEN 'one' || chr(10) || 'two'
  END AS note,
  CASE WHEN k >= 3 THEN 'CSV row has ' || CASE WHEN k = 4 THEN 1 WHEN wide THEN 6 ELSE 5 END
    || ' values but expected ' || CASE WHEN wide THEN 3 ELSE 2 END END AS parse_error
FROM c""",
)
def s2_csv_odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation with one of two headers; of five rows one has quotes and a delimiter in
    a quoted cell, one a bare quote, one a line break, one too many cells and one too few."""
    path = scratch_path(spark, "odd-csv")
    wide = F.col("c_nationkey") % 2 == 0
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    k = F.col("c_custkey") % 5
    rest = (
        F.when(k == 0, ',"say ""hi"", now"')
        .when(k == 1, ',5" wide')
        .when(k == 2, ',"one\ntwo"')
        .when(k == 3, ",a,b,c,d")
        .otherwise("")
    )
    mark = F.when(wide & (k < 4), ",m").otherwise("")
    rows = customers.withColumn("value", F.concat("c_custkey", mark, rest))
    header = F.when(wide, "id,mark,note").otherwise("id,note").alias("value")
    heads = customers.select("c_nationkey", F.lit(-1).alias("c_custkey"), header).distinct()
    ordered = rows.unionByName(heads).repartition("c_nationkey")
    ordered = ordered.sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    cells = [
        F.variant_get("payload", f"$.{c}", "string").alias(c) for c in ("id", "mark", "note")
    ]
    folder = F.element_at(F.split("file_path", "/"), -2).alias("folder")
    return read_csv(spark, [path]).select(folder, "record_index", *cells, "parse_error")


@query("s3_read_parquet", "SELECT doc_id, quality, true AS has_index FROM labels")
def s3_read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_parquet(spark, [f"{sf_dir}/labels.parquet"])
    return raw.select(
        F.variant_get("payload", "$.doc_id", "bigint").alias("doc_id"),
        F.variant_get("payload", "$.quality", "int").alias("quality"),
        F.col("record_index").isNotNull().alias("has_index"),
    )


@query(
    "s4_read_any",
    """SELECT 'csv' AS kind, count(*) AS n, count(*) AS n_text FROM labels
UNION ALL SELECT 'parquet', count(*), 0 FROM labels""",
)
def s4_read_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder with CSV and Parquet files; only the CSV keys arrive as text."""
    path, labels = scratch_path(spark, "mixed"), table(spark, sf_dir, "labels")
    labels.withColumn("kind", F.lit("csv")).write.option("header", "true").csv(f"{path}/a")
    labels.withColumn("kind", F.lit("parquet")).write.parquet(f"{path}/b")
    kind = F.variant_get("payload", "$.kind", "string").alias("kind")
    key = F.variant_get("payload", "$.doc_id", "variant")
    is_text = F.schema_of_variant(key) == "STRING"
    return (
        read_any(spark, [path])
        .groupBy(kind)
        .agg(F.count("*").alias("n"), F.count_if(is_text).alias("n_text"))
    )


_SIMPLE_SQL = """'{"id":' || doc_id || ',"lang":"' || lang || '"}'"""


def _simple_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"id":%d,"lang":"%s"}', "doc_id", "lang")
    return table(spark, sf_dir, "documents").select(text.alias("value"))


@query(
    "s5_record_fingerprint",
    f"SELECT doc_id AS id, sha256({_SIMPLE_SQL}) AS record_sha256 FROM documents",
)
def s5_record_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_jsonl(spark, [_written(_simple_lines(spark, sf_dir), "simple")])
    return raw.select(F.variant_get("payload", "$.id", "bigint").alias("id"), "record_sha256")


@query(
    "s6_file_fingerprint",
    """WITH f AS (
  SELECT c_nationkey, string_agg(c_custkey || ':' || c_mktsegment || chr(10), '' ORDER BY c_custkey)
    AS body FROM customer GROUP BY 1)
SELECT 'c_nationkey=' || c_nationkey AS folder, strlen(body) AS length, sha256(body) AS file_sha256
FROM f""",
)
def s6_file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file per nation, so that SQL can put the bytes of each together again."""
    path = scratch_path(spark, "nations")
    line = F.concat("c_custkey", F.lit(":"), "c_mktsegment").alias("value")
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", line)
    ordered = customers.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    folder = F.element_at(F.split("file_path", "/"), -2).alias("folder")
    return file_fingerprints(list_files(spark, [path])).select(folder, "length", "file_sha256")


@query(
    "s7_record_index",
    "SELECT count(*) AS n, count(*) AS numbered, count(*) AS in_order FROM documents",
)
def s7_record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file the indexes run from 0 without a gap and follow the order of the lines."""
    path = _written(_simple_lines(spark, sf_dir), "simple")
    raw = read_jsonl(spark, [path]).select(
        "file_path", "record_index", F.variant_get("payload", "$.id", "bigint").alias("id")
    )
    per_file = raw.groupBy("file_path").agg(
        F.count("*").alias("n"),
        (F.max("record_index") - F.min("record_index") + 1).alias("span"),
        F.count_distinct("record_index").alias("distinct"),
        F.min(F.col("id") - F.col("record_index")).alias("lo"),
        F.max(F.col("id") - F.col("record_index")).alias("hi"),
    )
    whole = F.least("span", "distinct")
    return per_file.agg(
        F.sum("n").alias("n"),
        F.sum(whole).alias("numbered"),
        F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n"))).alias("in_order"),
    )


@query(
    "s8_compressed_jsonl",
    f"SELECT doc_id AS id, sha256({_SIMPLE_SQL}) AS record_sha256 FROM documents",
)
def s8_compressed_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_simple_lines(spark, sf_dir), "gzip", compression="gzip")
    raw = read_jsonl(spark, [path])
    return raw.select(F.variant_get("payload", "$.id", "bigint").alias("id"), "record_sha256")


@query("s11_price_list", f"WITH {STAR_PRICING_SQL} SELECT * FROM star_pricing")
def s11_price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document with an entry per model; there are 25 part brands at any scale."""
    path, prices = scratch_path(spark, "prices"), star_pricing(spark, sf_dir)
    document = prices.agg(F.collect_list(F.struct(*prices.columns)).alias("prices"))
    document.write.json(path)
    return read_prices(spark, path)


# --------------------------------------------------------------------- imports


_DAY = datetime(2026, 2, 1, tzinfo=timezone.utc)


def _mapping(name: str) -> Mapping:
    """The turn mapping with the tool sequence mapped, so that files can share a session."""
    tool = DOCUMENT["entities"]["tool_call"]
    fields = {**tool["fields"], "sequence": {"from": "place", "transform": "to_int"}}
    entities = {**DOCUMENT["entities"], "tool_call": {**tool, "fields": fields}}
    return load_mapping({**DOCUMENT, "name": name, "entities": entities})


def deliveries(spark: SparkSession, sf_dir: str, *runs: str) -> tuple[Warehouse, list[DataFrame]]:
    """A new warehouse after the named imports, and the report of each.

    ``first`` and ``again`` bring all turns; ``second`` repeats the assistant turns in another
    file, so all of its rows are stored already.
    """
    store = Warehouse(spark, scratch_path(spark, "warehouse"))
    lines = delivered_lines(spark, sf_dir)
    all_turns = _written(lines, "delivery-1")
    reports = []
    for days, name in enumerate(runs):
        path, mapping = all_turns, _mapping("turns-1")
        if name == "second":
            path = _written(lines.where("role = 'assistant'"), "delivery-2")
            mapping = _mapping("turns-2")
        moment = _DAY + timedelta(days=days)
        reports.append(
            ingest(spark, [path], mapping, store, "minimal", imported_at=moment, file_format="jsonl")
        )
    return store, reports


_IMPORT_SQL = (
    DELIVERED_SQL
    + """,
readable AS (SELECT * FROM delivered WHERE problem IS NULL),
made_call AS (SELECT * FROM readable WHERE role = 'assistant' AND call_problem IS NULL),
made_part AS (SELECT p.* FROM kept_part p JOIN readable r USING (record_index)),
bad AS (
  SELECT record_index, 'unparseable_record' AS reason_code FROM delivered
  WHERE problem IS NOT NULL
  UNION ALL SELECT record_index, call_problem FROM readable WHERE call_problem IS NOT NULL
  UNION ALL SELECT record_index, 'missing_required_field' FROM first_bad
  WHERE record_index IN (SELECT record_index FROM readable))"""
)


def _totals_sql(scope: str) -> str:
    return f"""(SELECT count(*) FROM delivered WHERE {scope}) AS records,
  (SELECT count(DISTINCT sid) FROM readable WHERE {scope})
    + (SELECT count(*) FROM made_call WHERE {scope})
    + (SELECT count(*) FROM made_part WHERE {scope}) AS produced,
  (SELECT count(*) FROM bad JOIN delivered USING (record_index) WHERE {scope}) AS rejected"""


@query(
    "k4_committed_rows",
    f"""WITH {_IMPORT_SQL}
SELECT 'session' AS name, count(DISTINCT sid) AS n FROM readable
UNION ALL SELECT 'model_call', count(*) FROM made_call
UNION ALL SELECT 'tool_call', count(*) FROM made_part""",
)
def k4_committed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible rows after three imports, next to an unfinished one that stays invisible."""
    store, _ = deliveries(spark, sf_dir, "first", "again", "second")
    store.append("session", store.table("session"), "unfinished")
    counted = [
        store.table(name).select(F.lit(name).alias("name"))
        for name in ("session", "model_call", "tool_call")
    ]
    union = counted[0].union(counted[1]).union(counted[2])
    return union.groupBy("name").agg(F.count("*").alias("n"))


@query(
    "k5_repeated_import",
    f"""WITH {_IMPORT_SQL},
t AS (SELECT {_totals_sql('true')})
SELECT records AS record_count, produced AS imported_count, true AS already_imported FROM t""",
)
def k5_repeated_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (_, again) = deliveries(spark, sf_dir, "first", "again")
    return again.agg(
        F.sum("record_count").alias("record_count"),
        F.sum("imported_count").alias("imported_count"),
        F.bool_and("already_imported").alias("already_imported"),
    )


def _calls_of(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """A model call per turn of every fourth conversation."""
    turns = table(spark, sf_dir, "conversations").where(F.col("conv_id") % 4 == part)
    own = turns.select(
        F.lit("talks").alias("source_name"),
        F.concat(F.lit("c"), "conv_id").alias("external_id"),
        F.col("turn").cast("long").alias("sequence"),
    )
    missing = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in TABLES["model_call"].fields
        if f.name not in own.columns
    ]
    return own.select("*", *missing)


@query(
    "k1_rows_of_a_batch",
    """SELECT step, 'c' || conv_id AS external_id, CAST(turn AS BIGINT) AS sequence
FROM conversations, (VALUES ('before'), ('after')) AS s(step) WHERE conv_id % 4 = 1""",
)
def k1_rows_of_a_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four imports with a quarter of the sessions each: the stored rows that a batch of one
    quarter's sessions has to be compared with, before and after the imports are compacted."""
    store = Warehouse(spark, scratch_path(spark, "members"))
    for part in range(4):
        facts = [("model_call", _calls_of(spark, sf_dir, part))]
        store.append("model_call", facts[0][1], f"import-{part}")
        store.index_sessions(facts, f"import-{part}")
        store.commit(f"import-{part}")
    columns = ["external_id", "sequence"]
    found = []
    for step in ("before", "after"):
        rows = store.rows_of_sessions("model_call", _calls_of(spark, sf_dir, 1))
        found.append(rows.select(F.lit(step).alias("step"), *columns))
        store.compact()
    return found[0].union(found[1])


@query(
    "k4_compacted_rows",
    """SELECT 'c' || conv_id AS external_id, CAST(count(*) AS BIGINT) AS n, 1::BIGINT AS imports
FROM conversations GROUP BY 1""",
)
def k4_compacted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows once, in one import, after a compaction beside an unfinished import."""
    store = Warehouse(spark, scratch_path(spark, "compacted"))
    for part in range(4):
        store.append("model_call", _calls_of(spark, sf_dir, part), f"import-{part}")
        store.commit(f"import-{part}")
    store.append("model_call", _calls_of(spark, sf_dir, 0), "unfinished")
    store.compact()
    per_session = store.table("model_call").groupBy("external_id").agg(F.count("*").alias("n"))
    return per_session.withColumn(
        "imports", store.commits().agg(F.count("*").alias("imports")).scalar()
    )


@query("k6_reject_sink", f"WITH {_IMPORT_SQL}\nSELECT reason_code, count(*) AS n FROM bad GROUP BY 1")
def k6_reject_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, (first,) = deliveries(spark, sf_dir, "first")
    stored = store.table("import_reject").join(
        first.select("file_sha256"), "file_sha256", "left_semi"
    )
    return stored.groupBy("reason_code").agg(F.count("*").alias("n"))


@query(
    "k7_retention",
    f"""WITH {_IMPORT_SQL}
SELECT count(*) AS n_records, (SELECT count(*) FROM bad) AS n_payloads FROM delivered""",
)
def k7_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal retention keeps the payload of rejected records only."""
    store, (first,) = deliveries(spark, sf_dir, "first")
    stored = store.table("raw_record").join(
        first.select("file_sha256"), "file_sha256", "left_semi"
    )
    return stored.agg(
        F.count("*").alias("n_records"), F.count("payload_json").alias("n_payloads")
    )


@query(
    "k8_field_profile_sink",
    """SELECT 'doc_id' AS path, count(DISTINCT doc_id) AS distinct_count FROM labels
UNION ALL SELECT 'quality', count(DISTINCT quality) FROM labels
UNION ALL SELECT 'toxic', count(DISTINCT toxic) FROM labels""",
)
def k8_field_profile_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile is stored twice; the second time every path is there already."""
    store = Warehouse(spark, scratch_path(spark, "profiles"))
    raw = read_parquet(spark, [f"{sf_dir}/labels.parquet"])
    described = profile(raw.withColumn("file_key", F.sha2("file_path", 256)), sample_size=2)
    store.put_profile(described)
    store.put_profile(described)
    return store.table("field_profile").select("path", "distinct_count")


@query("k9_export_jsonl", "SELECT doc_id, quality, toxic FROM labels")
def k9_export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    export_jsonl(table(spark, sf_dir, "labels"), path)
    raw = read_jsonl(spark, [path])
    types = {"doc_id": "bigint", "quality": "int", "toxic": "int"}
    return raw.select(*[F.variant_get("payload", f"$.{c}", t).alias(c) for c, t in types.items()])


@query(
    "r1_r4_import_report",
    f"""WITH {_IMPORT_SQL},
missing AS (
  SELECT (SELECT count(*) FILTER (WHERE ok) + count(*) FILTER (WHERE said_at IS NULL)
          FROM made_part)
    + 2 * (SELECT count(*) FROM (SELECT DISTINCT sid FROM readable) WHERE sid NOT IN (
        SELECT sid FROM made_call UNION ALL SELECT sid FROM made_part WHERE said_at IS NOT NULL))
    AS n),
t AS (SELECT {_totals_sql('true')})
SELECT records AS record_count, produced AS imported_count, CAST(0 AS BIGINT) AS duplicate_count,
  rejected AS rejected_count, n AS missing_info_count, 'partial' AS display_status
FROM t, missing""",
)
def r1_r4_import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (first,) = deliveries(spark, sf_dir, "first")
    return total_report(first).drop("files")


@query(
    "s9_second_delivery",
    f"""WITH {_IMPORT_SQL},
t AS (SELECT {_totals_sql("role = 'assistant'")})
SELECT records AS record_count, CAST(0 AS BIGINT) AS imported_count, produced AS duplicate_count,
  rejected AS rejected_count FROM t""",
)
def s9_second_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (_, second) = deliveries(spark, sf_dir, "first", "second")
    total = total_report(second)
    return total.select("record_count", "imported_count", "duplicate_count", "rejected_count")


@query(
    "m16_sequence_over_files",
    f"""WITH {_IMPORT_SQL}
SELECT sid AS external_id, count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last,
  count(*) AS numbers FROM made_part GROUP BY 1""",
)
def m16_sequence_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions split over two files, imported one after the other: one gapless sequence."""
    store = Warehouse(spark, scratch_path(spark, "split-sessions"))
    turns = table(spark, sf_dir, "conversations")
    for parity in (0, 1):
        lines = delivered_lines(spark, sf_dir, turns.where(F.col("turn") % 2 == parity))
        path = _written(lines, f"turns-{parity}")
        ingest(
            spark, [path], load_mapping(DOCUMENT), store, "minimal", imported_at=_DAY,
            file_format="jsonl", sequence_scope="table",
        )
    return store.table("tool_call").groupBy("external_id").agg(
        F.count("*").alias("n"),
        F.min("sequence").alias("first"),
        F.max("sequence").alias("last"),
        F.count_distinct("sequence").alias("numbers"),
    )


@query("stream_ingest", f"WITH {_IMPORT_SQL}\nSELECT count(*) AS n FROM made_call")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same delivery arriving as a stream of files."""
    store = Warehouse(spark, scratch_path(spark, "stream-warehouse"))
    folder = _written(delivered_lines(spark, sf_dir), "arrivals")
    state = scratch_path(spark, "stream-state")
    running = ingest_stream(spark, folder, _mapping("turns-1"), store, state, file_format="jsonl")
    running.awaitTermination()
    return store.table("model_call").agg(F.count("*").alias("n"))
