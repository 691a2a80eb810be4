"""Metric queries over the views: filters, indicators, series, lists, details."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.cluster import cut_lineage
from tracewell.functions.measures import (
    duration_ms_rounded,
    duration_ms_truncated,
    error_count,
    ratio,
    utc_day,
)
from tracewell.functions.ranking import first_per_key, median
from tracewell.operators.views import (
    TraceTables,
    priced_calls,
    session_metrics,
    tool_usage_view,
)
from tracewell.schemas import SESSION_KEY

MAX_PAGE = 200


@dataclass(frozen=True)
class MetricFilter:
    """Scope of a metric query; an empty list means no restriction."""

    sources: Sequence[str] = ()
    agents: Sequence[str] = ()
    models: Sequence[str] = ()
    repositories: Sequence[str] = ()
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None


def _instant(value: datetime | str) -> Column:
    """A datetime or an ISO text; text without an offset is UTC (the session time zone)."""
    if isinstance(value, datetime):
        return F.timestamp_micros(F.lit(int(value.timestamp() * 1_000_000)))
    return F.lit(value).cast("timestamp")


def filter_sessions(
    sessions: DataFrame, scope: MetricFilter, model_call: DataFrame | None = None
) -> DataFrame:
    """Sessions in scope. ``models`` keeps a session when any of its calls used one of them.

    Works on the session table or on anything that carries its columns. The start bound is
    inclusive, the end bound exclusive, and sessions without a start leave a dated scope.
    """
    kept = sessions
    for column, values in (
        ("source_name", scope.sources),
        ("agent_name", scope.agents),
        ("repository_name", scope.repositories),
    ):
        if values:
            kept = kept.where(F.col(column).isin(*values))
    if scope.date_from is not None:
        kept = kept.where(F.col("started_at") >= _instant(scope.date_from))
    if scope.date_to is not None:
        kept = kept.where(F.col("started_at") < _instant(scope.date_to))
    if scope.models:
        if model_call is None:
            raise ValueError("a model filter needs the model_call table")
        used = model_call.where(F.col("model_name").isin(*scope.models))
        # distinct combines per map task, so a session with very many calls joins as one row
        kept = kept.join(used.select(*SESSION_KEY).distinct(), SESSION_KEY, "left_semi")
    return kept


def scoped_tables(tables: TraceTables, scope: MetricFilter) -> TraceTables:
    """Restrict sessions and calls to the scope before anything is aggregated.

    Source filters are pushed to the call tables, since calls carry the source. Any other
    scope is resolved once, written, and semi-joined to the calls; the written size decides
    whether the keys are broadcast.
    """
    session = filter_sessions(tables.session, scope, tables.model_call)
    model_call, tool_call = tables.model_call, tables.tool_call
    if _has_session_scope(scope):
        session = cut_lineage(session, "scope")
        keys = session.select(*SESSION_KEY)
        model_call = model_call.join(keys, SESSION_KEY, "left_semi")
        tool_call = tool_call.join(keys, SESSION_KEY, "left_semi")
    if scope.sources:
        model_call = model_call.where(F.col("source_name").isin(*scope.sources))
        tool_call = tool_call.where(F.col("source_name").isin(*scope.sources))
    return TraceTables(session, model_call, tool_call, tables.pricing)


def _indicator_sums() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [
        F.count("*").alias("session_count"),
        F.coalesce(F.sum("n_model_calls"), zero).alias("model_call_count"),
        F.coalesce(F.sum("n_tool_calls"), zero).alias("tool_call_count"),
        F.coalesce(F.sum("n_errors"), zero).alias("error_count"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.coalesce(F.max("cost_is_estimated") == 1, F.lit(False)).alias("cost_is_estimated"),
    ]


def with_rates(sums: DataFrame) -> DataFrame:
    """Ratios of sums, NULL when nothing was counted."""
    calls = F.col("model_call_count") + F.col("tool_call_count")
    return sums.withColumn("error_rate", ratio(F.col("error_count"), calls)).withColumn(
        "cache_hit_ratio", ratio(F.col("cached_tokens"), F.col("prompt_tokens"))
    )


def _has_session_scope(scope: MetricFilter) -> bool:
    """Whether the scope filters on anything but the source, which calls carry themselves."""
    return bool(
        scope.agents
        or scope.models
        or scope.repositories
        or scope.date_from is not None
        or scope.date_to is not None
    )


def _sums_without_sessions(tables: TraceTables) -> DataFrame:
    """Indicator sums straight from the calls.

    Every stored call has its session, so without a session filter the totals need no
    grouping by session and no join: three scans, each reduced to one row by its tasks.
    """
    calls = priced_calls(tables.model_call, tables.pricing)
    models = calls.agg(
        F.struct(
            F.count("*").alias("n"),
            F.coalesce(error_count(F.col("status")), F.lit(0).cast("long")).alias("errors"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum("cached_tokens").alias("cached_tokens"),
            F.sum("effective_cost_usd").alias("cost"),
            F.coalesce(F.bool_or("is_estimated"), F.lit(False)).alias("is_estimated"),
        ).alias("m")
    )
    tools = tables.tool_call.agg(
        F.struct(
            F.count("*").alias("n"),
            F.coalesce(error_count(F.col("status")), F.lit(0).cast("long")).alias("errors"),
        ).alias("t")
    )
    counted = tables.session.agg(F.count("*").alias("session_count"))
    return (
        counted.withColumn("m", models.scalar())
        .withColumn("t", tools.scalar())
        .select(
            "session_count",
            F.col("m.n").alias("model_call_count"),
            F.col("t.n").alias("tool_call_count"),
            (F.col("m.errors") + F.col("t.errors")).alias("error_count"),
            "m.total_tokens",
            "m.prompt_tokens",
            "m.completion_tokens",
            "m.cached_tokens",
            F.col("m.cost").alias("total_cost_usd"),
            F.col("m.is_estimated").alias("cost_is_estimated"),
        )
    )


def indicators(tables: TraceTables, scope: MetricFilter = MetricFilter()) -> DataFrame:
    """All indicators of a scope in one row; an empty scope gives zero counts, NULL measures."""
    scoped = scoped_tables(tables, scope)
    if _has_session_scope(scope):
        sums = session_metrics(scoped).agg(*_indicator_sums())
    else:
        sums = _sums_without_sessions(scoped)
    return with_rates(sums).withColumn(
        "median_session_duration_ms", median_duration(scoped).scalar()
    )


def median_duration(tables: TraceTables, scope: MetricFilter = MetricFilter()) -> DataFrame:
    """Exact median session duration in milliseconds. Reads sessions only, never the calls."""
    session = filter_sessions(tables.session, scope, tables.model_call)
    duration = duration_ms_rounded(F.col("started_at"), F.col("ended_at"))
    return median(session, duration, "median_session_duration_ms")


# The series a day can be plotted for.
SERIES = ("sessions", "tokens", "model_calls", "tool_calls", "cost", "errors")


def _series_value(metric: str) -> Column:
    match metric:
        case "sessions":
            return F.count("*")
        case "tokens":
            return F.sum("total_tokens")
        case "model_calls":
            return F.sum("n_model_calls")
        case "tool_calls":
            return F.sum("n_tool_calls")
        case "cost":
            return F.sum("total_cost_usd")
        case "errors":
            return F.sum("n_errors")
    raise ValueError(f"unknown metric {metric!r}; expected one of {', '.join(SERIES)}")


def timeseries(
    tables: TraceTables,
    metric: str,
    scope: MetricFilter = MetricFilter(),
    granularity: str = "day",
) -> DataFrame:
    """``(period, value)`` per UTC day that has a session, sorted; days without one are absent."""
    if granularity != "day":
        raise ValueError(f"unsupported granularity {granularity!r}: only 'day'")
    value = _series_value(metric)
    scoped = scoped_tables(tables, scope)
    if metric == "sessions":
        metrics = scoped.session  # the calls do not matter for a session count
    else:
        metrics = session_metrics(scoped)
    return (
        metrics.where("started_at IS NOT NULL")
        .groupBy(utc_day(F.col("started_at")).cast("string").alias("period"))
        .agg(value.cast("double").alias("value"))
        .orderBy("period")
    )


def sessions(
    tables: TraceTables, scope: MetricFilter = MetricFilter(), limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of sessions: newest first, untimed last, ties by key descending."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset >= 0")
    page = (
        filter_sessions(tables.session, scope, tables.model_call)
        .orderBy(*session_order())
        .offset(offset)
        .limit(limit)
    )
    # Written once, so that all sessions are sorted once and not per use of the page. It has at
    # most MAX_PAGE rows and is broadcast to prune both call scans.
    page = cut_lineage(page, "page")
    keys = F.broadcast(page.select(*SESSION_KEY))
    scoped = TraceTables(
        page,
        tables.model_call.join(keys, SESSION_KEY, "left_semi"),
        tables.tool_call.join(keys, SESSION_KEY, "left_semi"),
        tables.pricing,
    )
    return (
        session_metrics(scoped)
        .select(
            *SESSION_KEY,
            "agent_name",
            "repository_name",
            "started_at",
            "duration_ms",
            F.col("n_model_calls").alias("model_call_count"),
            F.col("n_tool_calls").alias("tool_call_count"),
            "total_tokens",
            "total_cost_usd",
            F.col("n_errors").alias("error_count"),
        )
        .orderBy(*session_order())
    )


def session_order() -> list[Column]:
    return [
        F.col("started_at").desc_nulls_last(),
        F.col("source_name").desc(),
        F.col("external_id").desc(),
    ]


def session_count(tables: TraceTables, scope: MetricFilter = MetricFilter()) -> DataFrame:
    """Total behind a session page."""
    scoped = filter_sessions(tables.session, scope, tables.model_call)
    return scoped.agg(F.count("*").alias("total"))


def timeline_events(model_call: DataFrame, tool_call: DataFrame) -> DataFrame:
    """Model and tool calls of every session as one event table, without an order."""
    shared = [*SESSION_KEY, "status", "error_type", "started_at", "ended_at"]
    models = model_call.select(
        *shared,
        F.lit("model_call").alias("kind"),
        "sequence",
        F.col("model_name").alias("name"),
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        "cost_usd",
    )
    tools = tool_call.select(
        *shared, F.lit("tool_call").alias("kind"), "sequence", F.col("tool_name").alias("name")
    )
    events = models.unionByName(tools, allowMissingColumns=True)
    duration = duration_ms_truncated(F.col("started_at"), F.col("ended_at"))
    return events.withColumn("duration_ms", duration)


def _one(df: DataFrame, source_name: str, external_id: str) -> DataFrame:
    return df.where(
        (F.col("source_name") == source_name) & (F.col("external_id") == external_id)
    )


def timeline(tables: TraceTables, source_name: str, external_id: str) -> DataFrame:
    """Ordered events of one session: untimed last, then start, kind, sequence."""
    events = timeline_events(
        _one(tables.model_call, source_name, external_id),
        _one(tables.tool_call, source_name, external_id),
    )
    return events.orderBy(F.col("started_at").asc_nulls_last(), "kind", "sequence")


def all_timelines(tables: TraceTables) -> DataFrame:
    """Events of all sessions in timeline order.

    A range-partitioned sort on key and time: one very long session spans several tasks.
    """
    events = timeline_events(tables.model_call, tables.tool_call)
    return events.orderBy(
        *SESSION_KEY, F.col("started_at").asc_nulls_last(), "kind", "sequence"
    )


def session_detail_aggregates(tables: TraceTables) -> DataFrame:
    """Declared totals and errors per session, from the calls (no price estimate here)."""
    events = timeline_events(tables.model_call, tables.tool_call)
    return events.groupBy(*SESSION_KEY).agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("total_cost_usd"),
        error_count(F.col("status")).alias("error_count"),
    )


def session_details(tables: TraceTables) -> DataFrame:
    """Detail header of every session: identity, bounds, truncated duration, totals."""
    header = tables.session.select(
        *SESSION_KEY,
        "agent_name",
        "repository_name",
        "started_at",
        "ended_at",
        duration_ms_truncated(F.col("started_at"), F.col("ended_at")).alias("duration_ms"),
        F.col("record_index").isNotNull().alias("has_raw_record"),
    )
    totals = session_detail_aggregates(tables)
    return header.join(totals, SESSION_KEY, "left").withColumn(
        "error_count", F.coalesce("error_count", F.lit(0).cast("long"))
    )


def session_detail(tables: TraceTables, source_name: str, external_id: str) -> DataFrame:
    """Detail header of one session; empty when unknown. Key filters reach all three scans."""
    return session_details(
        TraceTables(
            _one(tables.session, source_name, external_id),
            _one(tables.model_call, source_name, external_id),
            _one(tables.tool_call, source_name, external_id),
            tables.pricing,
        )
    )


def tool_usage(tool_call: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """Tools over all sources: summed counts and the unweighted mean of per-source means."""
    calls = tool_call.where(F.col("source_name").isin(*sources)) if sources else tool_call
    return (
        tool_usage_view(calls)
        .groupBy("tool_name")
        .agg(
            F.sum("n_calls").alias("n_calls"),
            F.sum("n_errors").alias("n_errors"),
            F.avg("avg_duration_ms").alias("avg_duration_ms"),
        )
        .orderBy(F.col("n_calls").desc(), "tool_name")
    )


def dimensions(tables: TraceTables) -> DataFrame:
    """Distinct non-empty agents and models, unfiltered and sorted."""

    def values(df: DataFrame, column: str, dimension: str) -> DataFrame:
        return (
            df.where(F.col(column) != "")
            .select(F.lit(dimension).alias("dimension"), F.col(column).alias("value"))
            .distinct()
        )

    agents = values(tables.session, "agent_name", "agent")
    models = values(tables.model_call, "model_name", "model")
    return agents.union(models).orderBy("dimension", "value")


def list_sources(source: DataFrame, session: DataFrame) -> DataFrame:
    """Every source with its session count, zero included, sorted by name."""
    counts = session.groupBy("source_name").agg(F.count("*").alias("n"))
    return (
        source.join(counts, source["name"] == counts["source_name"], "left")
        .select(
            source["name"].alias("name"),
            *[source[c] for c in source.columns if c != "name"],
            F.coalesce("n", F.lit(0).cast("long")).alias("session_count"),
        )
        .orderBy("name")
    )


def data_quality(view: DataFrame, source_name: str | None = None) -> DataFrame:
    """Import quality rows, newest first, optionally of one source."""
    rows = view.where(F.col("source_name") == source_name) if source_name else view
    return rows.orderBy(F.col("imported_at").desc(), F.col("file_sha256").desc())


def list_imports(import_batch: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of imports, newest first."""
    newest = import_batch.orderBy(F.col("imported_at").desc(), F.col("file_sha256").desc())
    return newest.offset(offset).limit(limit)


def import_by_sha(import_batch: DataFrame, file_sha256: str | None = None) -> DataFrame:
    """Newest import of one file hash, or of every hash."""
    rows = import_batch
    if file_sha256 is not None:
        rows = rows.where(F.col("file_sha256") == file_sha256)
    return first_per_key(
        rows, ["file_sha256"], [F.col("imported_at").desc(), F.col("source_name").desc()]
    )


def list_rejects(
    rejects: DataFrame, file_sha256: str, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of the rejects of an import, by record index; empty for an unknown import."""
    rows = rejects.where(F.col("file_sha256") == file_sha256)
    return rows.orderBy("record_index").offset(offset).limit(limit)


def count_rejects(rejects: DataFrame) -> DataFrame:
    """Number of rejects per import."""
    return rejects.groupBy("file_sha256").agg(F.count("*").alias("n_rejects"))


def latest_version(
    registry: DataFrame,
    key: str = "name",
    version: str = "version",
    active: str | None = "is_active",
    exact: int | None = None,
) -> DataFrame:
    """Newest active version per key, or the rows of one exact version."""
    if exact is not None:
        return registry.where(F.col(version) == exact)
    rows = registry.where(F.col(active)) if active else registry
    return first_per_key(rows, [key], [F.col(version).desc()])


def list_repositories(repository: DataFrame, source_name: str | None = None) -> DataFrame:
    rows = repository.where(F.col("source_name") == source_name) if source_name else repository
    return rows.orderBy("source_name", "name")


def provenance(facts: DataFrame, raw_record: DataFrame) -> DataFrame:
    """Each fact row with the raw record it came from; rows without one drop out."""
    raw = raw_record.select("file_sha256", "record_index", "record_sha256", "payload_json")
    return facts.join(raw, ["file_sha256", "record_index"])


def list_prices(pricing: DataFrame) -> DataFrame:
    return pricing.orderBy("model_name")
