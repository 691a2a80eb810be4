"""Sinks and table maintenance: keyed inserts, retention, exports, the import ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ranking import first_per_key
from tracewell.schemas import RETENTION_MODES


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key that ``target`` does not hold yet.

    Copies inside the batch are dropped before the join, so neither side has a repeated key.
    """
    return first_per_key(batch, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert_overwrite(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The whole table with the batch's rows in place of those with the same key."""
    repeated = batch.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"the batch repeats a key of {keys}")
    kept = target.join(batch.select(*keys), keys, "left_anti")
    return kept.select(*target.columns).unionByName(batch.select(*target.columns))


def harvest_repositories(rows: DataFrame, column: str = "repository_name") -> DataFrame:
    """Distinct non-empty repositories named by sessions (or raw records)."""
    named = rows.where(F.length(column) > 0)
    return named.select("source_name", F.col(column).alias("name")).distinct()


def harvest_values(raw: DataFrame, field: Column, name: str = "value") -> DataFrame:
    """Distinct non-empty texts of one payload field, sorted; unreadable records are skipped."""
    found = raw.where("parse_error IS NULL").select(field.alias(name))
    return found.where(F.length(name) > 0).distinct().orderBy(name)


def register_dimension(
    target: DataFrame, batch: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): an idempotent registration of dimension rows."""
    new = insert_ignore(target, batch, keys, [F.col(k) for k in keys])
    counts = batch.agg(F.count("*").alias("total")).withColumn(
        "registered", new.agg(F.count("*").alias("n")).scalar()
    )
    return new, counts.withColumn("skipped", F.col("total") - F.col("registered"))


def retain_payloads(raw: DataFrame, rejects: DataFrame, mode: str = "full") -> DataFrame:
    """Raw rows to store. ``minimal`` keeps payloads of rejected records only.

    ``raw`` carries ``file_sha256, record_index, record_sha256, payload_json``.
    """
    if mode not in RETENTION_MODES:
        raise ValueError(f"retention must be one of {', '.join(RETENTION_MODES)}")
    if mode == "full":
        return raw
    marked = rejects.select("file_sha256", "record_index", F.lit(True).alias("_rejected"))
    joined = raw.join(marked.distinct(), ["file_sha256", "record_index"], "left")
    return joined.withColumn(
        "payload_json", F.when(F.col("_rejected"), F.col("payload_json"))
    ).drop("_rejected")


def export_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object per line, as a folder of part files; NULL fields are kept."""
    df.write.option("ignoreNullFields", "false").json(path)
