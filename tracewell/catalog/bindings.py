"""Driver tables seen as trace tables, once as DataFrames and once as SQL.

Star binding: an order is a session, a line item a model call, a part brand a model.
Event binding: a user's UTC day is a session, an event a tool call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.cluster import configure
from tracewell.functions.measures import total_tokens
from tracewell.functions.ranking import running_number
from tracewell.operators.views import TraceTables


def table(spark: SparkSession, sf_dir: str, name: str, *extra: str) -> DataFrame:
    """One driver table; zone-less parquet timestamps are read as UTC instants."""
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    columns: list = []
    for column, dtype in df.dtypes:
        value = F.col(column)
        if dtype == "timestamp_ntz":
            value = value.cast("timestamp").alias(column)
        columns.append(value)
    return df.select(*columns, *extra)


def plus_micros(moment: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + micros.cast("long"))


# ---------------------------------------------------------------- star binding


def star_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    untimed = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")
    unended = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    length = F.round(F.col("o_totalprice") * 100).cast("long") * 1000
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("src"), F.col("o_orderkey") % 4).alias("source_name"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.col("o_orderpriority").alias("agent_name"),
        F.col("c_mktsegment").alias("repository_name"),
        F.when(~untimed, F.col("o_orderdate")).alias("started_at"),
        F.when(~unended, plus_micros(F.col("o_orderdate"), length)).alias("ended_at"),
        F.col("o_orderkey").alias("record_index"),
    )


STAR_SESSION_SQL = """star_session AS (
  SELECT 'src' || (o_orderkey % 4) AS source_name,
         CAST(o_orderkey AS VARCHAR) AS external_id,
         o_orderpriority AS agent_name,
         c_mktsegment AS repository_name,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'
              THEN NULL ELSE o_orderdate END AS started_at,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
              ELSE o_orderdate + to_microseconds(CAST(round(o_totalprice * 100) AS BIGINT) * 1000)
         END AS ended_at,
         o_orderkey AS record_index
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def star_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    prompt = (F.col("l_quantity") * 100).cast("long")
    completion = F.col("l_quantity").cast("long")
    status = (
        F.when((flag == "R") & (state == "F"), "error")
        .when((flag == "R") & (state == "O"), "timeout")
        .when((flag == "N") & (state == "F"), "cancelled")
        .when(flag == "N", "unknown")
        .otherwise("success")
    )
    length = F.round(F.col("l_extendedprice")).cast("long") * 1000
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("src"), F.col("l_orderkey") % 4).alias("source_name"),
        F.col("l_orderkey").cast("string").alias("external_id"),
        F.col("l_linenumber").cast("long").alias("sequence"),
        F.col("p_brand").alias("model_name"),
        F.col("p_type").alias("provider"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        F.when(flag != "N", F.round(F.col("l_discount") * 1000).cast("long")).alias(
            "cached_tokens"
        ),
        total_tokens(prompt, completion).alias("total_tokens"),
        F.when(flag == "A", F.round(F.col("l_extendedprice")) / 10000.0).alias("cost_usd"),
        F.col("l_shipdate").alias("started_at"),
        F.when(state == "F", plus_micros(F.col("l_shipdate"), length)).alias("ended_at"),
        status.alias("status"),
        F.when(status == "error", "model_error").when(status == "timeout", "timeout").alias(
            "error_type"
        ),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_tax",
    )


STAR_CALL_SQL = """star_call AS (
  SELECT 'src' || (l_orderkey % 4) AS source_name,
         CAST(l_orderkey AS VARCHAR) AS external_id,
         CAST(l_linenumber AS BIGINT) AS sequence,
         p_brand AS model_name, p_type AS provider,
         CAST(l_quantity * 100 AS BIGINT) AS prompt_tokens,
         CAST(l_quantity AS BIGINT) AS completion_tokens,
         CASE WHEN l_returnflag <> 'N' THEN CAST(round(l_discount * 1000) AS BIGINT) END
           AS cached_tokens,
         CAST(l_quantity * 100 AS BIGINT) + CAST(l_quantity AS BIGINT) AS total_tokens,
         CASE WHEN l_returnflag = 'A' THEN round(l_extendedprice) / 10000.0 END AS cost_usd,
         l_shipdate AS started_at,
         CASE WHEN l_linestatus = 'F'
              THEN l_shipdate + to_microseconds(CAST(round(l_extendedprice) AS BIGINT) * 1000)
         END AS ended_at,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'error'
              WHEN l_returnflag = 'R' THEN 'timeout'
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'cancelled'
              WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'success' END AS status,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'model_error'
              WHEN l_returnflag = 'R' THEN 'timeout' END AS error_type,
         l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def star_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices for the brands numbered 1x and 2x; the other brands have none."""
    part = table(spark, sf_dir, "part")
    priced = part.where(F.col("p_brand").rlike("^Brand#[12][0-9]$"))
    return priced.groupBy(F.col("p_brand").alias("model_name")).agg(
        F.min("p_size").cast("double").alias("input_usd_per_mtok"),
        F.max("p_size").cast("double").alias("output_usd_per_mtok"),
        F.max(F.when(F.col("p_type") == "SMALL", F.length("p_name"))).cast("double").alias(
            "cached_usd_per_mtok"
        ),
    )


STAR_PRICING_SQL = """star_pricing AS (
  SELECT p_brand AS model_name,
         CAST(min(p_size) AS DOUBLE) AS input_usd_per_mtok,
         CAST(max(p_size) AS DOUBLE) AS output_usd_per_mtok,
         CAST(max(CASE WHEN p_type = 'SMALL' THEN length(p_name) END) AS DOUBLE)
           AS cached_usd_per_mtok
  FROM part WHERE regexp_matches(p_brand, '^Brand#[12][0-9]$') GROUP BY p_brand)"""


# --------------------------------------------------------------- event binding


def event_calls(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    number = F.get_json_object("props", "$.k").cast("long")
    status = (
        F.when(kind == "error", "error")
        .when(kind == "signup", "timeout")
        .when(kind == "click", "success")
        .otherwise("unknown")
    )
    length = F.round(F.col("value") * 1000).cast("long")
    calls = events.select(
        F.concat(F.lit("src"), F.col("user_id") % 3).alias("source_name"),
        F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias(
            "external_id"
        ),
        F.concat(F.lit("tool_"), number % 10).alias("tool_name"),
        F.col("ts").alias("started_at"),
        F.when(kind != "view", plus_micros(F.col("ts"), length)).alias("ended_at"),
        status.alias("status"),
        F.when(status == "error", "tool_error").when(status == "timeout", "timeout").alias(
            "error_type"
        ),
        number.alias("input_bytes"),
        F.col("event_id").alias("record_index"),
    )
    if not numbered:
        return calls.withColumn("sequence", F.col("record_index"))
    return running_number(
        calls,
        ["source_name", "external_id"],
        "record_index",
        [F.col("record_index")],
        "sequence",
    )


EVENT_CALL_SQL = """event_raw AS (
  SELECT 'src' || (user_id % 3) AS source_name,
         CAST(user_id AS VARCHAR) || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS external_id,
         'tool_' || (CAST(props->>'$.k' AS BIGINT) % 10) AS tool_name,
         ts AS started_at,
         CASE WHEN event_type <> 'view'
              THEN ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) END AS ended_at,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout'
              WHEN 'click' THEN 'success' ELSE 'unknown' END AS status,
         CASE event_type WHEN 'error' THEN 'tool_error' WHEN 'signup' THEN 'timeout' END
           AS error_type,
         CAST(props->>'$.k' AS BIGINT) AS input_bytes,
         event_id AS record_index
  FROM events),
event_call AS (
  SELECT *, row_number() OVER (PARTITION BY source_name, external_id
                               ORDER BY record_index) - 1 AS sequence
  FROM event_raw)"""


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions bounded by their events; a day that only has views has no end."""
    calls = event_calls(spark, sf_dir, numbered=False)
    bounds = calls.groupBy("source_name", "external_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("_last_end"),
        F.min("record_index").alias("record_index"),
    )
    return bounds.select(
        "source_name",
        "external_id",
        F.substring_index("external_id", "@", 1).alias("agent_name"),
        F.lit(None).cast("string").alias("repository_name"),
        "started_at",
        F.col("_last_end").alias("ended_at"),
        "record_index",
    )


EVENT_SESSION_SQL = """event_session AS (
  SELECT source_name, external_id, split_part(external_id, '@', 1) AS agent_name,
         CAST(NULL AS VARCHAR) AS repository_name,
         min(started_at) AS started_at, max(ended_at) AS ended_at,
         min(record_index) AS record_index
  FROM event_call GROUP BY source_name, external_id)"""


def star_tables(spark: SparkSession, sf_dir: str) -> TraceTables:
    """Star sessions with model calls; tool calls are the returned lines again, as tools."""
    calls = star_calls(spark, sf_dir)
    return TraceTables(
        session=star_sessions(spark, sf_dir),
        model_call=calls,
        tool_call=star_tools(spark, sf_dir),
        pricing=star_pricing(spark, sf_dir),
    )


def star_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call per returned line: the tool is the part type, run right after the call."""
    calls = star_calls(spark, sf_dir).where("status IN ('error', 'timeout', 'success')")
    return calls.select(
        "source_name",
        "external_id",
        "sequence",
        F.concat(F.lit("tool_"), F.lower("provider")).alias("tool_name"),
        F.col("sequence").alias("model_call_sequence"),
        "started_at",
        "ended_at",
        "status",
        "error_type",
        F.col("prompt_tokens").alias("input_bytes"),
        F.col("completion_tokens").alias("output_bytes"),
    )


STAR_TOOL_SQL = """star_tool AS (
  SELECT source_name, external_id, sequence, 'tool_' || lower(provider) AS tool_name,
         sequence AS model_call_sequence, started_at, ended_at, status, error_type,
         prompt_tokens AS input_bytes, completion_tokens AS output_bytes
  FROM star_call WHERE status IN ('error', 'timeout', 'success'))"""

STAR_SQL = ",\n".join([STAR_SESSION_SQL, STAR_CALL_SQL, STAR_TOOL_SQL, STAR_PRICING_SQL])
EVENT_SQL = ",\n".join([EVENT_CALL_SQL, EVENT_SESSION_SQL])


def event_tables(spark: SparkSession, sf_dir: str, numbered: bool = False) -> TraceTables:
    """Event sessions with tool calls only; ordinals are computed only where they are shown."""
    return TraceTables(
        session=event_sessions(spark, sf_dir),
        model_call=star_calls(spark, sf_dir).where("false"),
        tool_call=event_calls(spark, sf_dir, numbered),
        pricing=star_pricing(spark, sf_dir),
    )
