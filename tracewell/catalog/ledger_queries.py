"""Import ledger, quality and reject queries; event-chain resolution.

Ledger binding: an order is an imported file, its line items are the file's rows: returned
ones count as duplicates, accepted ones as imported, the others as rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.bindings import table
from tracewell.catalog.metric_queries import rounded
from tracewell.catalog.registry import query
from tracewell.operators import dashboard as D
from tracewell.operators import metrics as M
from tracewell.operators.ancestry import detect_exports, resolve_ancestry, with_session_ids
from tracewell.operators.ingest import display_status, report, total_report
from tracewell.operators.views import data_quality_view


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    counts = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("n"),
        F.count_if(flag == "A").alias("a"),
        F.count_if(flag == "R").alias("r"),
        F.count_if(flag == "N").alias("x"),
        F.sum(F.col("l_linenumber").cast("long")).alias("m"),
    )
    orders = table(spark, sf_dir, "orders")
    zero = F.lit(0).cast("long")
    return orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("src"), F.col("o_orderkey") % 4).alias("source_name"),
        F.col("o_orderkey").cast("string").alias("file_sha256"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"),
        F.col("o_orderdate").alias("imported_at"),
        F.coalesce("n", zero).alias("record_count"),
        F.coalesce("a", zero).alias("imported_count"),
        F.coalesce("r", zero).alias("duplicate_count"),
        F.coalesce("x", zero).alias("rejected_count"),
        F.coalesce("m", zero).alias("missing_info_count"),
        F.col("o_custkey").cast("string").alias("content_sha256"),
    )


LEDGER_SQL = """counts AS (
  SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a,
    count(*) FILTER (WHERE l_returnflag = 'R') AS r,
    count(*) FILTER (WHERE l_returnflag = 'N') AS x,
    CAST(sum(l_linenumber) AS BIGINT) AS m FROM lineitem GROUP BY 1),
ledger AS (
  SELECT 'src' || (o_orderkey % 4) AS source_name, CAST(o_orderkey AS VARCHAR) AS file_sha256,
    CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'succeeded' END AS status,
    o_orderdate AS imported_at, coalesce(n, 0) AS record_count,
    coalesce(a, 0) AS imported_count, coalesce(r, 0) AS duplicate_count,
    coalesce(x, 0) AS rejected_count, coalesce(m, 0) AS missing_info_count,
    CAST(o_custkey AS VARCHAR) AS content_sha256
  FROM orders LEFT JOIN counts ON o_orderkey = l_orderkey)"""


def field_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the rejected rows only, so many files have none."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("file_sha256"),
        F.col("l_linenumber").cast("string").alias("path"),
        F.col("l_discount").alias("null_ratio"),
    )


QUALITY_SQL = (
    LEDGER_SQL
    + """,
fp AS (SELECT CAST(l_orderkey AS VARCHAR) AS file_sha256, count(*) AS n_fields,
         avg(l_discount) AS avg_null_ratio FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
quality AS (
  SELECT l.source_name, l.file_sha256, status, imported_at, record_count, imported_count,
    duplicate_count, rejected_count, missing_info_count,
    CAST(imported_count AS DOUBLE) / nullif(record_count, 0) AS completeness_ratio,
    coalesce(n_fields, 0) AS n_profiled_fields, avg_null_ratio
  FROM ledger l LEFT JOIN fp USING (file_sha256))"""
)
_QUALITY = """SELECT * REPLACE (round(completeness_ratio, 6) AS completeness_ratio,
  round(avg_null_ratio, 6) AS avg_null_ratio) FROM quality"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_quality_view(ledger(spark, sf_dir), field_profiles(spark, sf_dir))


@query("v9_data_quality", f"WITH {QUALITY_SQL}\n{_QUALITY}")
def v9_data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_quality(spark, sf_dir), "completeness_ratio", "avg_null_ratio")


@query("q17_data_quality_of_source", f"WITH {QUALITY_SQL}\n{_QUALITY} WHERE source_name = 'src2'")
def q17_data_quality_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.data_quality(_quality(spark, sf_dir), "src2")
    return rounded(rows, "completeness_ratio", "avg_null_ratio")


@query(
    "q18_list_imports",
    f"""WITH {LEDGER_SQL}
SELECT * FROM ledger ORDER BY imported_at DESC, file_sha256 DESC LIMIT 50 OFFSET 10""",
)
def q18_list_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the import list, as the feature shows it."""
    return M.list_imports(ledger(spark, sf_dir), 50, 10)


@query(
    "q19_import_by_sha",
    f"""WITH {LEDGER_SQL}
SELECT content_sha256 AS file_sha256, source_name, imported_at FROM ledger
QUALIFY row_number() OVER (PARTITION BY content_sha256
                           ORDER BY imported_at DESC, source_name DESC) = 1""",
)
def q19_import_by_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_content = ledger(spark, sf_dir).select(
        F.col("content_sha256").alias("file_sha256"), "source_name", "imported_at"
    )
    return M.import_by_sha(by_content)


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    code = F.when(F.col("l_linestatus") == "F", "schema_violation").otherwise("transform_failed")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("file_sha256"),
        F.col("l_linenumber").cast("long").alias("record_index"),
        code.alias("reason_code"),
        F.concat(F.lit("Unknown "), "p_brand").alias("reason_detail"),
    )


REJECT_SQL = """rejects AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS file_sha256, CAST(l_linenumber AS BIGINT) AS record_index,
    CASE WHEN l_linestatus = 'F' THEN 'schema_violation' ELSE 'transform_failed' END
      AS reason_code, 'Unknown ' || p_brand AS reason_detail
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N')"""


@query(
    "q20_list_rejects",
    f"WITH {REJECT_SQL}\nSELECT * FROM rejects WHERE file_sha256 = (SELECT max(file_sha256) "
    "FROM rejects) ORDER BY record_index LIMIT 50",
)
def q20_list_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rejects(spark, sf_dir)
    return M.list_rejects(found, found.agg(F.max("file_sha256")).first()[0])


@query(
    "q20_count_rejects",
    f"WITH {REJECT_SQL}\nSELECT file_sha256, count(*) AS n_rejects FROM rejects GROUP BY 1",
)
def q20_count_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.count_rejects(rejects(spark, sf_dir))


@query(
    "d11_quality_totals",
    f"""WITH {LEDGER_SQL}
SELECT CAST(sum(imported_count) AS BIGINT) AS imported,
  CAST(sum(duplicate_count) AS BIGINT) AS duplicates,
  CAST(sum(rejected_count) AS BIGINT) AS rejected,
  round(CAST(sum(rejected_count) AS DOUBLE)
    / (sum(imported_count) + sum(duplicate_count) + sum(rejected_count)), 6) AS reject_rate,
  round(CAST(sum(duplicate_count) AS DOUBLE)
    / (sum(imported_count) + sum(duplicate_count) + sum(rejected_count)), 6) AS duplicate_rate
FROM ledger""",
)
def d11_quality_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.quality_totals(ledger(spark, sf_dir)), "reject_rate", "duplicate_rate")


@query(
    "d12_completeness_band",
    f"""WITH {QUALITY_SQL}
SELECT CASE WHEN completeness_ratio IS NULL THEN 'unknown' WHEN completeness_ratio >= 0.9 THEN 'good'
  WHEN completeness_ratio >= 0.75 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n
FROM quality GROUP BY 1""",
)
def d12_completeness_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = D.completeness_band(F.col("completeness_ratio")).alias("band")
    return _quality(spark, sf_dir).groupBy(band).agg(F.count("*").alias("n"))


@query(
    "d13_search_rejects",
    f"""WITH {REJECT_SQL}
SELECT * FROM rejects WHERE contains(lower(reason_code), 'brand#1')
  OR contains(lower(reason_detail), 'brand#1')""",
)
def d13_search_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.search_rejects(rejects(spark, sf_dir), "BRAND#1")


_STATUS_SQL = """CASE WHEN status = 'failed' THEN 'failed'
  WHEN status IN ('pending', 'running') OR rejected_count > 0 THEN 'partial'
  ELSE 'completed' END"""


@query(
    "r5_display_status",
    f"WITH {LEDGER_SQL}\nSELECT file_sha256, {_STATUS_SQL} AS display_status FROM ledger",
)
def r5_display_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = display_status(F.col("status"), F.col("rejected_count"))
    return ledger(spark, sf_dir).select("file_sha256", shown.alias("display_status"))


@query(
    "r6_total_report",
    f"""WITH {LEDGER_SQL}
SELECT count(*) AS files, CAST(sum(record_count) AS BIGINT) AS record_count,
  CAST(sum(imported_count) AS BIGINT) AS imported_count,
  CAST(sum(duplicate_count) AS BIGINT) AS duplicate_count,
  CAST(sum(rejected_count) AS BIGINT) AS rejected_count,
  CAST(sum(missing_info_count) AS BIGINT) AS missing_info_count,
  CASE WHEN bool_or({_STATUS_SQL} = 'failed') THEN 'failed'
       WHEN bool_or({_STATUS_SQL} = 'partial') THEN 'partial' ELSE 'completed' END
    AS display_status FROM ledger""",
)
def r6_total_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_report(report(ledger(spark, sf_dir)))


# ---------------------------------------------------------------- event chains


def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event hangs off the one before it; a sign-up opens a session.

    Cheap errors have lost their parent, so what follows them falls back.
    """
    lost = (F.col("event_type") == "error") & (F.col("value") < 5)
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("file_key"),
        F.col("event_id").alias("record_index"),
        F.concat(F.lit("e"), "event_id").alias("id"),
        F.when(~lost, F.concat(F.lit("e"), F.col("event_id") - 1)).alias("parent_id"),
        (F.col("event_type") == "signup").alias("is_session"),
    )


CHAIN_SQL = """seen AS (
  SELECT event_id, event_type,
    max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS s,
    max(CASE WHEN event_type = 'error' AND value < 5 THEN event_id END) OVER w AS b
  FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
chained AS (
  SELECT event_id AS record_index, 'e' || (CASE
    WHEN s > coalesce(b, -1) THEN s
    ELSE (SELECT min(event_id) FROM events WHERE event_type = 'signup') END) AS session_id
  FROM seen)"""


@query("m29_resolve_ancestry", f"WITH {CHAIN_SQL}\nSELECT record_index, session_id FROM chained")
def m29_resolve_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_ancestry(chain_events(spark, sf_dir))
    return resolved.select("record_index", "session_id")


def _chain_records(spark: SparkSession, sf_dir: str, file_key) -> DataFrame:
    kind = F.when(F.col("is_session"), "session").otherwise("message")
    payload = F.struct(
        F.col("id"),
        F.col("parent_id").alias("parentId"),
        kind.alias("type"),
    )
    return chain_events(spark, sf_dir).select(
        file_key.alias("file_key"),
        "record_index",
        F.parse_json(F.to_json(payload)).alias("payload"),
        F.lit(None).cast("string").alias("parse_error"),
    )


@query(
    "m29_with_session_ids",
    f"""WITH {CHAIN_SQL}
SELECT record_index, session_id, 'e' || record_index AS id FROM chained""",
)
def m29_with_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _chain_records(spark, sf_dir, F.lit("events"))
    return with_session_ids(raw).select(
        "record_index",
        F.variant_get("payload", "$.session_id", "string").alias("session_id"),
        F.variant_get("payload", "$.id", "string").alias("id"),
    )


@query(
    "m30_detect_exports",
    """SELECT CASE WHEN event_type = 'signup' THEN 'opening' ELSE 'other' END AS file_key,
  bool_or(event_type = 'signup') AS is_export FROM events GROUP BY 1""",
)
def m30_detect_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_key = F.when(F.col("is_session"), "opening").otherwise("other")
    return detect_exports(_chain_records(spark, sf_dir, file_key))
