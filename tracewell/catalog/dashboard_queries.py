"""Dashboard analytics over the star and event bindings."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.bindings import (
    EVENT_CALL_SQL,
    EVENT_SQL,
    STAR_SESSION_SQL,
    event_calls,
    event_sessions,
    event_tables,
    star_sessions,
    star_tables,
    table,
)
from tracewell.catalog.metric_queries import SESSION_METRICS_SQL, TOOL_USAGE_SQL, rounded
from tracewell.catalog.registry import query
from tracewell.functions.measures import duration_ms_rounded
from tracewell.operators import dashboard as D
from tracewell.operators import metrics as M
from tracewell.operators import views as V


def _breakdown_sql(source: str, dimension: str, measure: str) -> str:
    return f"""{source},
totals AS (SELECT coalesce({dimension}, '—') AS category, sum({measure}) AS value
  FROM base WHERE ({measure}) IS NOT NULL GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC, category) AS rn FROM totals),
folded AS (
  SELECT category, value, false AS is_folded FROM ranked WHERE rn <= 6
  UNION ALL
  SELECT 'Autres', sum(value), true FROM ranked WHERE rn > 6
  HAVING sum(value) > 0)"""


@query(
    "d1_breakdown_sessions",
    _breakdown_sql(
        f"""WITH {STAR_SESSION_SQL},
{EVENT_SQL},
base AS (SELECT agent_name AS dim FROM star_session
  UNION ALL SELECT CASE WHEN ended_at IS NOT NULL THEN agent_name END FROM event_session)""",
        "dim",
        "1",
    )
    + """
SELECT category, CAST(value AS BIGINT) AS value,
  round(CAST(value AS DOUBLE) / (SELECT sum(value) FROM totals), 6) AS share, is_folded
FROM folded""",
)
def d1_breakdown_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of both bindings by agent; users without an ended session have no agent."""
    ended = F.when(F.col("ended_at").isNotNull(), F.col("agent_name"))
    sessions = star_sessions(spark, sf_dir).select(F.col("agent_name").alias("dim"))
    sessions = sessions.unionByName(event_sessions(spark, sf_dir).select(ended.alias("dim")))
    return rounded(D.breakdown(sessions, "dim"), "share")


@query(
    "d1_breakdown_tokens",
    _breakdown_sql(
        f"WITH {SESSION_METRICS_SQL},\nbase AS (SELECT agent_name, total_tokens FROM session_metrics)",
        "agent_name",
        "total_tokens",
    )
    + """
SELECT category, CAST(value AS BIGINT) AS value,
  round(CAST(value AS DOUBLE) / (SELECT sum(value) FROM totals), 6) AS share, is_folded
FROM folded""",
)
def d1_breakdown_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = V.session_metrics(star_tables(spark, sf_dir))
    return rounded(D.breakdown(metrics, "agent_name", F.col("total_tokens")), "share")


@query(
    "d2_top_sessions_by_cost",
    f"""WITH {SESSION_METRICS_SQL}
SELECT source_name, external_id, round(total_cost_usd, 6) AS total_cost_usd
FROM session_metrics WHERE total_cost_usd IS NOT NULL
ORDER BY round(total_cost_usd, 6) DESC, source_name, external_id LIMIT 5""",
)
def d2_top_sessions_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = rounded(V.session_metrics(star_tables(spark, sf_dir)), "total_cost_usd")
    return D.top_sessions_by_cost(metrics).select("source_name", "external_id", "total_cost_usd")


_SERIES = "SELECT CAST(started_at AS DATE) AS d FROM event_session WHERE started_at IS NOT NULL"


@query(
    "d3_resolve_period",
    f"""WITH {EVENT_SQL}
SELECT CAST(min(d) AS TIMESTAMP) AS period_from,
  CAST(max(d) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS period_to
FROM ({_SERIES})""",
)
def d3_resolve_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolve_period(M.timeseries(event_tables(spark, sf_dir), "sessions"))


@query(
    "d4_previous_period",
    f"""WITH {EVENT_SQL},
p AS (SELECT CAST(min(d) AS TIMESTAMP) AS period_from,
        CAST(max(d) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS period_to
      FROM ({_SERIES}))
SELECT period_from, period_to,
  period_from - (period_to - period_from) - INTERVAL 1 MILLISECOND AS previous_from,
  period_from - INTERVAL 1 MILLISECOND AS previous_to FROM p""",
)
def d4_previous_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = M.timeseries(event_tables(spark, sf_dir), "sessions")
    return D.previous_period(D.resolve_period(series))


_COMPARED = [
    "session_count",
    "model_call_count",
    "tool_call_count",
    "total_tokens",
    "total_cost_usd",
    "error_rate",
]
_WINDOW_SUMS = """SELECT count(*) AS session_count,
    CAST(coalesce(sum(n_model_calls), 0) AS BIGINT) AS model_call_count,
    CAST(coalesce(sum(n_tool_calls), 0) AS BIGINT) AS tool_call_count,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(total_cost_usd) AS total_cost_usd,
    CAST(sum(n_errors) AS DOUBLE) / nullif(sum(n_model_calls) + sum(n_tool_calls), 0)
      AS error_rate
  FROM session_metrics"""


@query(
    "d5_period_comparison",
    f"""WITH {SESSION_METRICS_SQL},
cur AS ({_WINDOW_SUMS} WHERE started_at >= TIMESTAMP '1997-01-01'
        AND started_at < TIMESTAMP '1997-07-01'),
prev AS ({_WINDOW_SUMS} WHERE started_at >= TIMESTAMP '1996-07-03 23:59:59.999'
         AND started_at < TIMESTAMP '1996-12-31 23:59:59.999')
SELECT """
    + ", ".join(
        (
            f"round(cur.{n}, 6) AS current_{n}, round(prev.{n}, 6) AS previous_{n}"
            if n in ("total_cost_usd", "error_rate")
            else f"cur.{n} AS current_{n}, prev.{n} AS previous_{n}"
        )
        + f", round((CAST(cur.{n} AS DOUBLE) - prev.{n}) / nullif(abs(CAST(prev.{n} AS DOUBLE)), 0), 6)"
        f" AS delta_{n}"
        for n in _COMPARED
    )
    + " FROM cur, prev",
)
def d5_period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = D.period_comparison(
        star_tables(spark, sf_dir),
        datetime(1997, 1, 1, tzinfo=timezone.utc),
        datetime(1997, 7, 1, tzinfo=timezone.utc),
    )
    plain = [f"{s}_{n}" for n in ("total_cost_usd", "error_rate") for s in ("current", "previous")]
    return rounded(rounded(compared, *[f"delta_{n}" for n in _COMPARED]), *plain)


@query(
    "d6_day_drilldown",
    f"""WITH {EVENT_SQL}
SELECT s.source_name, s.external_id, s.started_at, count(*) AS n_tool_calls
FROM event_session s JOIN event_call c USING (source_name, external_id)
WHERE CAST(s.started_at AS DATE) = DATE '2024-01-10' GROUP BY 1, 2, 3""",
)
def d6_day_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = M.scoped_tables(event_tables(spark, sf_dir), D.day_scope(date(2024, 1, 10)))
    return V.session_metrics(tables).select(
        "source_name", "external_id", "started_at", "n_tool_calls"
    )


@query(
    "d7_duration_histogram",
    f"""WITH {SESSION_METRICS_SQL},
b AS (SELECT min(duration_ms) AS lo, max(duration_ms) AS hi FROM session_metrics),
n AS (SELECT least(7, CAST(floor((duration_ms - lo) / ((hi - lo) / 8.0)) AS INTEGER)) AS bucket,
        count(*) AS n FROM session_metrics CROSS JOIN b WHERE duration_ms IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bucket, round(lo + i * ((hi - lo) / 8.0), 6) AS bucket_start,
  round(lo + (i + 1) * ((hi - lo) / 8.0), 6) AS bucket_end, coalesce(n, 0) AS n_sessions
FROM range(8) t(i) CROSS JOIN b LEFT JOIN n ON n.bucket = i""",
)
def d7_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = star_tables(spark, sf_dir).session
    timed = sessions.select(
        duration_ms_rounded(F.col("started_at"), F.col("ended_at")).alias("duration_ms")
    )
    return rounded(D.duration_histogram(timed), "bucket_start", "bucket_end")


@query(
    "d8_per_session_ratios",
    f"""WITH {SESSION_METRICS_SQL}
SELECT round(CAST(sum(n_model_calls) + sum(n_tool_calls) AS DOUBLE) / count(*), 6)
    AS calls_per_session,
  round(CAST(sum(total_tokens) AS DOUBLE) / count(*), 6) AS tokens_per_session,
  round(sum(total_cost_usd) / count(*), 6) AS cost_per_session,
  round(CAST(sum(n_model_calls) AS DOUBLE) / (sum(n_model_calls) + sum(n_tool_calls)), 6)
    AS model_share,
  round(CAST(sum(n_tool_calls) AS DOUBLE) / (sum(n_model_calls) + sum(n_tool_calls)), 6)
    AS tool_share
FROM session_metrics""",
)
def d8_per_session_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = V.session_metrics(star_tables(spark, sf_dir)).agg(*M._indicator_sums())
    ratios = D.per_session_ratios(sums)
    return rounded(ratios, *ratios.columns)


@query(
    "d9_untimed_count",
    f"""WITH {EVENT_SQL}
SELECT count(*) FILTER (WHERE ended_at IS NULL) AS untimed, count(*) AS sessions
FROM event_session""",
)
def d9_untimed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = event_tables(spark, sf_dir).session
    duration = duration_ms_rounded(F.col("started_at"), F.col("ended_at"))
    return D.untimed_count(sessions.select(duration.alias("duration_ms")))


@query(
    "d10_tool_breakdown",
    f"""WITH {EVENT_CALL_SQL},
{TOOL_USAGE_SQL},
u AS (SELECT tool_name, CAST(sum(n_calls) AS BIGINT) AS n_calls,
        CAST(sum(n_errors) AS BIGINT) AS n_errors, avg(avg_duration_ms) AS avg_duration_ms
      FROM tool_usage GROUP BY tool_name)
SELECT tool_name, n_calls, n_calls - n_errors AS n_success, n_errors,
  round(CAST(n_calls AS DOUBLE) / (SELECT sum(n_calls) FROM u), 6) AS share,
  round(CAST(n_errors AS DOUBLE) / n_calls, 6) AS error_rate,
  round(avg_duration_ms, 5) AS avg_duration_ms
FROM u ORDER BY n_calls DESC, tool_name LIMIT 12""",
)
def d10_tool_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = M.tool_usage(event_calls(spark, sf_dir, numbered=False))
    split = rounded(D.tool_breakdown(usage), "share", "error_rate")
    return rounded(split, "avg_duration_ms", places=5)
