"""Metric views: per-session measures, daily activity, tool usage, import quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.measures import (
    duration_ms_rounded,
    error_count,
    estimated_cost,
    is_error,
    ratio,
    utc_day,
)
from tracewell.schemas import SESSION_KEY


@dataclass(frozen=True)
class TraceTables:
    """The fact tables and the price list the views read."""

    session: DataFrame
    model_call: DataFrame
    tool_call: DataFrame
    pricing: DataFrame


def priced_calls(model_call: DataFrame, pricing: DataFrame) -> DataFrame:
    """Model calls with ``effective_cost_usd`` and whether it had to be estimated.

    The price list is a dimension: Catalyst broadcasts it when its known size is under the
    configured threshold and shuffles otherwise, so nothing unbounded is ever shipped.
    """
    prices = pricing.select(
        F.col("model_name").alias("_priced"),
        "input_usd_per_mtok",
        "output_usd_per_mtok",
        "cached_usd_per_mtok",
    )
    estimate = estimated_cost(
        F.col("prompt_tokens"),
        F.col("completion_tokens"),
        F.col("cached_tokens"),
        F.col("input_usd_per_mtok"),
        F.col("output_usd_per_mtok"),
        F.col("cached_usd_per_mtok"),
    )
    return (
        model_call.join(prices, F.col("model_name") == F.col("_priced"), "left")
        .withColumn("effective_cost_usd", F.coalesce("cost_usd", estimate))
        .withColumn("is_estimated", F.col("cost_usd").isNull() & F.col("_priced").isNotNull())
        .drop(*prices.columns)
    )


def model_agg(model_call: DataFrame, pricing: DataFrame) -> DataFrame:
    """One row per session: call count, token sums, cost, estimated calls, errors."""
    return (
        priced_calls(model_call, pricing)
        .groupBy(*SESSION_KEY)
        .agg(
            F.count("*").alias("n_model_calls"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum("cached_tokens").alias("cached_tokens"),
            F.sum("effective_cost_usd").alias("total_cost_usd"),
            F.sum(F.col("is_estimated").cast("long")).alias("n_estimated_cost"),
            error_count(F.col("status")).alias("n_model_errors"),
        )
    )


def tool_agg(tool_call: DataFrame) -> DataFrame:
    """One row per session: tool call count and errors."""
    return tool_call.groupBy(*SESSION_KEY).agg(
        F.count("*").alias("n_tool_calls"), error_count(F.col("status")).alias("n_tool_errors")
    )


def session_metrics(tables: TraceTables) -> DataFrame:
    """One row per session. Calls are aggregated before the joins, so nothing fans out."""
    models = model_agg(tables.model_call, tables.pricing)
    tools = tool_agg(tables.tool_call)
    wide = tables.session.join(models, SESSION_KEY, "left").join(tools, SESSION_KEY, "left")
    zero = F.lit(0).cast("long")

    def count(name: str):
        return F.coalesce(F.col(name), zero)

    return wide.select(
        *SESSION_KEY,
        "agent_name",
        "repository_name",
        "started_at",
        "ended_at",
        duration_ms_rounded(F.col("started_at"), F.col("ended_at")).alias("duration_ms"),
        count("n_model_calls").alias("n_model_calls"),
        count("n_tool_calls").alias("n_tool_calls"),
        "total_tokens",
        "prompt_tokens",
        "completion_tokens",
        "cached_tokens",
        ratio(F.col("cached_tokens"), F.col("prompt_tokens")).alias("cache_hit_ratio"),
        "total_cost_usd",
        (count("n_estimated_cost") > 0).cast("int").alias("cost_is_estimated"),
        (count("n_model_errors") + count("n_tool_errors")).alias("n_errors"),
    )


def daily_activity(tables: TraceTables) -> DataFrame:
    """Sessions, calls and tokens per source and UTC day; untimed sessions are left out.

    ``(source_name, external_id)`` is unique in ``session``, so counting rows counts
    distinct sessions.
    """
    models = tables.model_call.groupBy(*SESSION_KEY).agg(
        F.count("*").alias("m"), F.sum("total_tokens").alias("tokens")
    )
    tools = tables.tool_call.groupBy(*SESSION_KEY).agg(F.count("*").alias("t"))
    timed = tables.session.where("started_at IS NOT NULL").select(
        *SESSION_KEY, utc_day(F.col("started_at")).alias("day")
    )
    zero = F.lit(0).cast("long")
    return (
        timed.join(models, SESSION_KEY, "left")
        .join(tools, SESSION_KEY, "left")
        .groupBy("source_name", "day")
        .agg(
            F.count("*").alias("n_sessions"),
            F.coalesce(F.sum("m"), zero).alias("n_model_calls"),
            F.coalesce(F.sum("t"), zero).alias("n_tool_calls"),
            F.sum("tokens").alias("total_tokens"),
        )
    )


def tool_usage_view(tool_call: DataFrame) -> DataFrame:
    """Calls, errors, error rate and mean duration of timed calls per source and tool."""
    duration = duration_ms_rounded(F.col("started_at"), F.col("ended_at"))
    return (
        tool_call.groupBy("source_name", "tool_name")
        .agg(
            F.count("*").alias("n_calls"),
            error_count(F.col("status")).alias("n_errors"),
            F.avg(duration).alias("avg_duration_ms"),
        )
        .withColumn("error_rate", ratio(F.col("n_errors"), F.col("n_calls")))
    )


def data_quality_view(import_batch: DataFrame, field_profile: DataFrame) -> DataFrame:
    """Counters, completeness and mean null ratio per import.

    ``imported_count`` counts entity rows, so completeness may exceed 1.
    """
    profiled = field_profile.groupBy("file_sha256").agg(
        F.count("*").alias("n_fields"), F.avg("null_ratio").alias("avg_null_ratio")
    )
    return import_batch.join(profiled, "file_sha256", "left").select(
        "source_name",
        "file_sha256",
        "status",
        "imported_at",
        "record_count",
        "imported_count",
        "duplicate_count",
        "rejected_count",
        "missing_info_count",
        ratio(F.col("imported_count"), F.col("record_count")).alias("completeness_ratio"),
        F.coalesce("n_fields", F.lit(0).cast("long")).alias("n_profiled_fields"),
        "avg_null_ratio",
    )


def flag_errors(calls: DataFrame) -> DataFrame:
    """Calls with ``is_error``: only error and timeout count, cancelled and unknown do not."""
    return calls.withColumn("is_error", is_error(F.col("status")))
