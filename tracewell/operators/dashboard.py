"""Dashboard analytics over whole tables: breakdowns, period comparison, histograms."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.measures import ratio
from tracewell.operators.metrics import (
    MetricFilter,
    _indicator_sums,
    filter_sessions,
    with_rates,
)
from tracewell.operators.views import TraceTables, session_metrics

# Display limits of the dashboard and the labels of folded or absent groups.
MAX_SLICES = 6
TOOL_LIMIT = 12
OTHERS = "Autres"
UNAVAILABLE = "—"


def breakdown(
    sessions: DataFrame, dimension: str, measure: Column | None = None, slices: int = MAX_SLICES
) -> DataFrame:
    """Top slices of a dimension, the rest folded into one row, with shares of the total.

    NULL measures are skipped and a NULL dimension gets a placeholder. Ties are ordered by
    category. The result is empty when the total is not positive.
    """
    value = F.lit(1).cast("long") if measure is None else measure
    totals = (
        sessions.select(
            F.coalesce(F.col(dimension), F.lit(UNAVAILABLE)).alias("category"),
            value.alias("value"),
        )
        .where(F.col("value").isNotNull())
        .groupBy("category")
        .agg(F.sum("value").alias("value"))
    )
    head = totals.orderBy(F.col("value").desc(), "category").limit(slices)
    # The head holds at most ``slices`` rows, a bound set by the caller.
    tail = (
        totals.join(F.broadcast(head.select("category")), "category", "left_anti")
        .agg(F.sum("value").alias("value"))
        .where("value > 0")
        .select(F.lit(OTHERS).alias("category"), "value", F.lit(True).alias("is_folded"))
    )
    grand_total = totals.agg(F.sum("value").alias("t")).scalar()
    return (
        head.withColumn("is_folded", F.lit(False))
        .unionByName(tail)
        .withColumn("_total", grand_total)
        .where("_total > 0")
        .select(
            "category",
            "value",
            ratio(F.col("value"), F.col("_total")).alias("share"),
            "is_folded",
        )
        .orderBy("is_folded", F.col("value").desc(), "category")
    )


def top_sessions_by_cost(metrics: DataFrame, limit: int = 5) -> DataFrame:
    """Costliest sessions; sessions without a cost are dropped, ties ordered by key."""
    return (
        metrics.where("total_cost_usd IS NOT NULL")
        .orderBy(F.col("total_cost_usd").desc(), "source_name", "external_id")
        .limit(limit)
    )


def resolve_period(series: DataFrame, scope: MetricFilter = MetricFilter()) -> DataFrame:
    """``(period_from, period_to)``: the explicit dates, else first to last day of the series.

    One row; both columns are NULL when there is neither a date filter nor a day.
    """
    first, last = F.min("period").cast("date"), F.max("period").cast("date")
    if scope.date_from is not None and scope.date_to is not None:
        start, end = F.lit(scope.date_from), F.lit(scope.date_to)
        return series.agg(
            F.max(start.cast("timestamp")).alias("period_from"),
            F.max(end.cast("timestamp")).alias("period_to"),
        )
    return series.agg(
        first.cast("timestamp").alias("period_from"),
        (F.date_add(last, 1).cast("timestamp") - F.expr("INTERVAL '0.001' SECOND")).alias(
            "period_to"
        ),
    )


def previous_period(period: DataFrame) -> DataFrame:
    """The window of equal length that ends one millisecond before ``period`` starts."""
    start, end = F.unix_millis("period_from"), F.unix_millis("period_to")
    valid = end > start
    return period.select(
        "period_from",
        "period_to",
        F.when(valid, F.timestamp_millis(start - (end - start) - 1)).alias("previous_from"),
        F.when(valid, F.timestamp_millis(start - 1)).alias("previous_to"),
    )


def relative_delta(current: Column, previous: Column) -> Column:
    """Relative change; NULL without a value on either side or from a zero baseline."""
    return ratio(
        current.cast("double") - previous.cast("double"), F.abs(previous.cast("double"))
    )


def period_comparison(
    tables: TraceTables,
    date_from: datetime,
    date_to: datetime,
    scope: MetricFilter = MetricFilter(),
) -> DataFrame:
    """Indicators of a window and of the preceding one, with deltas, in one scan.

    Both windows are half-open. The earlier one has the same length and ends one
    millisecond before the later one starts.
    """
    start, end = _utc(date_from), _utc(date_to)
    if end <= start:
        raise ValueError("date_to must be after date_from")
    gap = timedelta(milliseconds=1)
    earlier, before = start - (end - start) - gap, start - gap
    wide = MetricFilter(
        scope.sources, scope.agents, scope.models, scope.repositories, earlier, end
    )
    session = filter_sessions(tables.session, wide, tables.model_call)
    metrics = session_metrics(
        TraceTables(session, tables.model_call, tables.tool_call, tables.pricing)
    )
    moment = F.unix_micros("started_at")

    def within(low: datetime, high: datetime) -> Column:
        return (moment >= _micros(low)) & (moment < _micros(high))

    window = F.when(within(start, end), "current").when(within(earlier, before), "previous")
    sums = (
        metrics.withColumn("window", window)
        .where("window IS NOT NULL")
        .groupBy("window")
        .agg(*_indicator_sums())
    )
    rated = with_rates(sums)
    compared = [
        "session_count",
        "model_call_count",
        "tool_call_count",
        "total_tokens",
        "total_cost_usd",
        "error_rate",
    ]

    def pick(name: str, side: str) -> Column:
        value = F.max(F.when(F.col("window") == side, F.col(name)))
        return F.coalesce(value, F.lit(0).cast("long")) if name.endswith("_count") else value

    both = rated.agg(
        *[pick(n, side).alias(f"{side}_{n}") for n in compared for side in ("current", "previous")]
    )
    return both.withColumns(
        {
            f"delta_{n}": relative_delta(F.col(f"current_{n}"), F.col(f"previous_{n}"))
            for n in compared
        }
    )


def _utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment


def _micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def day_scope(day: date) -> MetricFilter:
    """Scope of one UTC day, the whole of it: ``[day, day + 1)``."""
    start = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
    return MetricFilter(date_from=start, date_to=start + timedelta(days=1))


def duration_histogram(metrics: DataFrame, buckets: int = 8) -> DataFrame:
    """Equal-width buckets between the shortest and longest duration; empty ones are kept.

    The last bucket is closed. One bucket when all durations are equal, none without data.
    """
    durations = metrics.where("duration_ms IS NOT NULL").select("duration_ms")
    low = durations.agg(F.min("duration_ms").alias("v")).scalar()
    high = durations.agg(F.max("duration_ms").alias("v")).scalar()
    bounded = durations.withColumn("lo", low).withColumn("hi", high)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(buckets))
    index = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(
        F.least(
            F.lit(buckets - 1),
            F.floor((F.col("duration_ms") - F.col("lo")) / F.nullif(width, F.lit(0.0))),
        )
    )
    counts = bounded.groupBy(index.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    spark = metrics.sparkSession
    frame = (
        spark.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .withColumn("lo", low)
        .withColumn("hi", high)
        .where("lo IS NOT NULL AND (hi > lo OR bucket = 0)")
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(buckets))
    return (
        frame.join(counts, "bucket", "left")
        .select(
            "bucket",
            (F.col("lo") + F.col("bucket") * step).alias("bucket_start"),
            F.when(F.col("hi") == F.col("lo"), F.col("hi").cast("double"))
            .otherwise(F.col("lo") + (F.col("bucket") + 1) * step)
            .alias("bucket_end"),
            F.coalesce("n", F.lit(0).cast("long")).alias("n_sessions"),
        )
        .orderBy("bucket")
    )


def per_session_ratios(indicator_row: DataFrame) -> DataFrame:
    """Calls, tokens and cost per session; model and tool share of all calls."""
    n, calls = F.col("session_count"), F.col("model_call_count") + F.col("tool_call_count")
    return indicator_row.select(
        ratio(calls, n).alias("calls_per_session"),
        ratio(F.col("total_tokens"), n).alias("tokens_per_session"),
        ratio(F.col("total_cost_usd"), n).alias("cost_per_session"),
        ratio(F.col("model_call_count"), calls).alias("model_share"),
        ratio(F.col("tool_call_count"), calls).alias("tool_share"),
    )


def untimed_count(metrics: DataFrame) -> DataFrame:
    """Sessions without a duration, next to all sessions."""
    return metrics.agg(
        F.count_if(F.col("duration_ms").isNull()).alias("untimed"), F.count("*").alias("sessions")
    )


def tool_breakdown(usage: DataFrame, limit: int = TOOL_LIMIT) -> DataFrame:
    """Busiest tools with success/error split, error rate and share of all calls."""
    total = usage.agg(F.sum("n_calls").alias("t")).scalar()
    return (
        usage.orderBy(F.col("n_calls").desc(), "tool_name")
        .limit(limit)
        .withColumn("_total", total)
        .select(
            "tool_name",
            "n_calls",
            (F.col("n_calls") - F.col("n_errors")).alias("n_success"),
            "n_errors",
            ratio(F.col("n_calls"), F.col("_total")).alias("share"),
            ratio(F.col("n_errors"), F.col("n_calls")).alias("error_rate"),
            "avg_duration_ms",
        )
        .orderBy(F.col("n_calls").desc(), "tool_name")
    )


def quality_totals(quality: DataFrame) -> DataFrame:
    """Imported rows, and reject and duplicate rates over all handled rows."""
    sums = quality.agg(
        F.sum("imported_count").alias("imported"),
        F.sum("duplicate_count").alias("duplicates"),
        F.sum("rejected_count").alias("rejected"),
    )
    handled = F.col("imported") + F.col("duplicates") + F.col("rejected")
    return sums.withColumn("reject_rate", ratio(F.col("rejected"), handled)).withColumn(
        "duplicate_rate", ratio(F.col("duplicates"), handled)
    )


def completeness_band(completeness: Column) -> Column:
    """``good`` from 0.9, ``fair`` from 0.75, else ``poor``; ``unknown`` when NULL."""
    return (
        F.when(completeness.isNull(), "unknown")
        .when(completeness >= 0.9, "good")
        .when(completeness >= 0.75, "fair")
        .otherwise("poor")
    )


def search_rejects(rejects: DataFrame, text: str) -> DataFrame:
    """Rejects whose code or detail contains the text, ignoring case."""
    needle = F.lit(text.lower())
    code, detail = F.lower("reason_code"), F.lower(F.coalesce("reason_detail", F.lit("")))
    return rejects.where(code.contains(needle) | detail.contains(needle))
