"""Corpus statistics and extract building: sampling, caps, joins, token and tool tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.joins import join_spread
from tracewell.functions.measures import ratio, sha1_mod
from tracewell.functions.ranking import select_by_rank, top_n_per_group


def hash_sample(df: DataFrame, key: str, modulo: int) -> DataFrame:
    """Rows of whole entities whose ``sha1(key)`` is divisible by ``modulo``."""
    return df.where(sha1_mod(F.col(key).cast("string"), modulo) == 0)


def cap_per_group(
    entities: DataFrame, group: str, order: list[Column], n: int, unknown: str = "?"
) -> DataFrame:
    """At most ``n`` entities per group, by first appearance or by sorted id."""
    labelled = entities.withColumn(
        "_group", F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit(unknown))
    )
    return top_n_per_group(labelled, ["_group"], order, n).drop("_group")


def first_seen(rows: DataFrame, entity: str, group: str, position: str) -> DataFrame:
    """One row per (group, entity) with the position of its first line."""
    return rows.groupBy(group, entity).agg(F.min(position).alias("first_seen"))


def keep_entities(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of the chosen entities."""
    return join_spread(rows, chosen.select(*keys).distinct(), keys, "left_semi")


def split_degenerate(
    entities: DataFrame, activity: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(entities with activity, entities without any)."""
    active = activity.select(*keys).distinct()
    return entities.join(active, keys, "left_semi"), entities.join(active, keys, "left_anti")


def denormalise(
    turns: DataFrame, sessions: DataFrame, repositories: DataFrame, key: str, repo_key: str
) -> DataFrame:
    """Turns with the columns of their session and, where known, of its repository."""
    described = sessions.join(repositories, repo_key, "left")
    return join_spread(turns, described, [key])


def extract_report(rows: DataFrame, kept: DataFrame, provider: str, entity: str) -> DataFrame:
    """Rows scanned and kept, entities and tool records per provider, over the kept rows.

    ``kept`` needs ``n_tools``. Entities are first reduced to one row each, so the per
    provider counts never see the raw rows of a busy entity.
    """
    per_entity = kept.groupBy(provider, entity).agg(
        F.count("*").alias("rows"), F.sum("n_tools").alias("tools")
    )
    scanned = rows.agg(F.count("*").alias("n")).scalar()
    return (
        per_entity.groupBy(provider)
        .agg(
            F.count("*").alias("sessions"),
            F.sum("rows").alias("rounds"),
            F.sum("tools").alias("tool_records"),
        )
        .withColumn("rows_scanned", scanned)
    )


def distinct_with_unknown(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column, an absent or empty value counting as one of its own."""
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("?"))
    return df.select(label.alias("v")).distinct().agg(F.count("*").alias(name))


def distinct_present(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-empty values of a column."""
    return df.where(F.col(column) != "").select(column).distinct().agg(F.count("*").alias(name))


def token_sums(rounds: DataFrame, provider: str, columns: list[str]) -> DataFrame:
    """Sum of every token column per provider; absent values are skipped."""
    return rounds.groupBy(provider).agg(
        F.count("*").alias("rounds"), *[F.sum(c).alias(c) for c in columns]
    )


def composition(sums: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Share of each part in the total and whether the parts add up to it."""
    added = F.lit(0).cast("long")
    for part in parts:
        added = added + F.coalesce(F.col(part), F.lit(0).cast("long"))
    shares = {f"{p}_share": ratio(F.col(p), F.col(total)) for p in parts}
    return sums.withColumns(shares).withColumn(
        "is_balanced", added == F.coalesce(F.col(total), F.lit(0).cast("long"))
    )


def cache_reading_rounds(rounds: DataFrame, cached: str) -> DataFrame:
    """Rounds that read the cache, and their share."""
    reading = F.count_if(F.coalesce(F.col(cached), F.lit(0)) > 0)
    counted = rounds.agg(reading.alias("reading_rounds"), F.count("*").alias("rounds"))
    return counted.withColumn("share", ratio(F.col("reading_rounds"), F.col("rounds")))


def input_output_ratio(
    rounds: DataFrame, provider: str, tokens_in: str, tokens_out: str
) -> DataFrame:
    """Input/output token ratio per provider, and overall where the provider is NULL."""
    sums = rounds.rollup(provider).agg(
        F.grouping(provider).alias("is_total"),
        F.sum(tokens_in).alias("input_tokens"),
        F.sum(tokens_out).alias("output_tokens"),
    )
    return sums.withColumn("in_out_ratio", ratio(F.col("input_tokens"), F.col("output_tokens")))


def covered_period(df: DataFrame, stamps: Column) -> DataFrame:
    """First and last instant found in an array column of instants; NULLs are skipped."""
    return df.select(
        F.array_min(stamps).alias("lo"), F.array_max(stamps).alias("hi")
    ).agg(F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))


def tool_error_table(
    calls: DataFrame, keys: list[str], is_error: Column, min_calls: int = 100
) -> DataFrame:
    """Calls, errors and error rate for groups with enough calls, worst first."""
    return (
        calls.groupBy(*keys)
        .agg(F.count("*").alias("n_calls"), F.sum(is_error.cast("long")).alias("n_errors"))
        .where(F.col("n_calls") >= min_calls)
        .withColumn("error_rate", ratio(F.col("n_errors"), F.col("n_calls")))
        .orderBy(F.col("error_rate").desc(), *keys)
    )


def rounds_distribution(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Min, median, mean, p90 and max of rounds per session.

    The p90 is the element at position ``max(0, floor(0.9 n) - 1)`` of the sorted counts.
    """
    per_session = rounds.groupBy(*keys).agg(F.count("*").alias("n_rounds"))
    ranked = select_by_rank(
        per_session,
        F.col("n_rounds"),
        {
            "lo": lambda n: F.floor((n - 1) / 2),
            "hi": lambda n: F.floor(n / 2),
            "p90_rounds": lambda n: F.greatest(
                F.lit(0).cast("long"), F.floor(F.lit(0.9) * n) - 1
            ),
        },
    )
    plain = per_session.agg(
        F.count("*").alias("sessions"),
        F.min("n_rounds").alias("min_rounds"),
        F.avg("n_rounds").alias("mean_rounds"),
        F.max("n_rounds").alias("max_rounds"),
    )
    picked = ranked.select(
        F.struct(((F.col("lo") + F.col("hi")) / 2.0).alias("median"), "p90_rounds")
    )
    return (
        plain.withColumn("_picked", picked.scalar())
        .withColumn("median_rounds", F.col("_picked.median"))
        .withColumn("p90_rounds", F.col("_picked.p90_rounds"))
        .drop("_picked")
    )
