"""Importing trace files into a warehouse of Parquet tables.

An import writes all its rows under its own ``import_id`` partition and adds one row to the
``commit`` table last. Readers look at committed imports only, so a failed import leaves
nothing visible.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.cluster import broadcast_if_small, configure, cut_lineage
from tracewell.functions.joins import join_spread
from tracewell.functions.ranking import first_per_key
from tracewell.operators.ancestry import with_session_ids
from tracewell.operators.normalise import link_repositories, normalise
from tracewell.operators.store import retain_payloads
from tracewell.operators.warehouse import FACT_KEYS, TABLES, Warehouse
from tracewell.plans.mapping import Mapping
from tracewell.sources.files import detect_format, file_fingerprints, list_files
from tracewell.sources.readers import READERS


def file_ledger(spark: SparkSession, paths: list[str], store: Warehouse, source: str) -> DataFrame:
    """``file_path, file_sha256, file_order, already_imported`` of the incoming files.

    A file is already imported when a succeeded import of the same source has its hash, or
    when an earlier file of this batch is identical.
    """
    files = cut_lineage(file_fingerprints(list_files(spark, paths)), "fingerprints")
    done = (
        store.table("import_batch")
        .where((F.col("source_name") == source) & (F.col("status") == "succeeded"))
        .select("file_sha256")
        .distinct()
        .withColumn("_done", F.lit(True))
    )
    first = first_per_key(files, ["file_sha256"], [F.col("file_path")]).select(
        F.col("file_path").alias("_first"), F.col("file_sha256")
    )
    return (
        files.join(done, "file_sha256", "left")
        .join(first, "file_sha256")
        .select(
            "file_path",
            "file_sha256",
            (F.col("_done").isNotNull() | (F.col("_first") != F.col("file_path"))).alias(
                "already_imported"
            ),
        )
    )


def _per_file(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("file_sha256").agg(F.count("*").alias(name))


def ingest(
    spark: SparkSession,
    paths: list[str],
    mapping: Mapping,
    store: Warehouse,
    retention: str = "full",
    resolve_chains: bool = False,
    imported_at: datetime | None = None,
    file_format: str | None = None,
    sequence_scope: str = "file",
) -> DataFrame:
    """Import files with one mapping; returns one report row per file.

    The format of a file follows from its suffix unless ``file_format`` names it.

    Rows whose natural key is stored already, or came earlier in the batch, count as
    duplicates. ``resolve_chains`` first assigns sessions in event-chain exports.

    Calls without a mapped sequence are numbered per file and session, so those of a session's
    second file have the numbers of the first and count as duplicates. With ``sequence_scope``
    "table" the numbers go on where the stored ones and those of earlier files end.
    """
    if sequence_scope not in ("file", "table"):
        raise ValueError('sequence_scope must be "file" or "table"')
    configure(spark)
    moment = imported_at or datetime.now(timezone.utc)
    ledger = cut_lineage(file_ledger(spark, paths, store, mapping.source_name), "ledger")
    known = ledger.collect()  # one row per file
    new = sorted(r.file_path for r in known if not r.already_imported)
    if new:
        formats = {path: file_format or detect_format(path) for path in new}
        _import_files(
            spark, formats, ledger, mapping, store, retention, resolve_chains, moment,
            sequence_scope,
        )
    batches = first_per_key(
        store.table("import_batch").where(F.col("source_name") == mapping.source_name),
        ["file_sha256"],
        [F.col("imported_at").desc()],
    )
    return report(ledger.join(batches, "file_sha256"))


_SESSION = ["source_name", "external_id"]


def _numbered_on(calls: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """Calls whose own numbering goes on after the stored rows and the batch's earlier files.

    A session costs a row per file: the numbers it used there are its high-water mark.
    """
    used = (
        calls.where("auto_sequence")
        .groupBy(*_SESSION, "file_sha256")
        .agg((F.max("sequence") + 1).alias("used"))
        .join(files.select("file_sha256", "file_order"), "file_sha256")
    )
    marks = stored.groupBy(*_SESSION).agg((F.max("sequence") + 1).alias("mark"))
    along = Window.partitionBy(*_SESSION).orderBy("file_order")
    shift = F.sum("used").over(along) - F.col("used") + F.coalesce("mark", F.lit(0))
    shifts = used.join(marks, _SESSION, "left").select(
        *_SESSION, "file_sha256", shift.alias("shift")
    )
    shifts = cut_lineage(shifts, "sequence-shifts")
    moved = join_spread(calls, shifts, [*_SESSION, "file_sha256"], "left")
    number = F.when(F.col("auto_sequence"), F.col("sequence") + F.col("shift"))
    return moved.withColumn("sequence", F.coalesce(number, "sequence")).drop("shift")


def _import_files(
    spark: SparkSession,
    formats: dict[str, str],
    ledger: DataFrame,
    mapping: Mapping,
    store: Warehouse,
    retention: str,
    resolve_chains: bool,
    moment: datetime,
    sequence_scope: str,
) -> None:
    import_id = uuid.uuid4().hex
    listed = spark.createDataFrame(
        [(path, i, kind) for i, (path, kind) in enumerate(formats.items())],
        "file_path string, file_order int, file_format string",
    )
    files = broadcast_if_small(
        ledger.where("NOT already_imported")
        .join(listed, "file_path")
        .select("file_path", "file_sha256", "file_order", "file_format")
    )
    by_kind: dict[str, list[str]] = {}
    for path, kind in formats.items():
        by_kind.setdefault(kind, []).append(path)
    scans = [READERS[kind](spark, paths) for kind, paths in by_kind.items()]
    raw = reduce(DataFrame.unionByName, scans).join(
        files.select("file_path", F.col("file_sha256").alias("file_key")), "file_path"
    )
    if resolve_chains:
        raw = with_session_ids(raw)
    in_table = sequence_scope == "table"
    result = normalise(raw, mapping, mark_auto=in_table)
    rejects = store.append("import_reject", result.rejects, import_id)
    stored = raw.select(
        F.col("file_key").alias("file_sha256"),
        "record_index",
        "record_sha256",
        F.when(F.col("parse_error").isNull(), F.to_json("payload"))
        .otherwise(F.lit("{}"))
        .alias("payload_json"),
    )
    records = store.append("raw_record", retain_payloads(stored, rejects, retention), import_id)

    sessions = link_repositories(result.sessions, store.table("repository"))
    produced: list[DataFrame] = []
    written: list[DataFrame] = []
    facts: list[tuple[str, DataFrame]] = []
    place = [F.col("file_order"), F.col("record_index")]
    for name, rows in (
        ("session", sessions),
        ("model_call", result.model_calls),
        ("tool_call", result.tool_calls),
    ):
        if in_table and name != "session":
            rows = _numbered_on(rows, files, store.rows_of_sessions(name, rows))
        placed = rows.join(files.select("file_sha256", "file_order"), "file_sha256")
        added = store.not_stored(name, placed, place)
        stored_rows = store.append(name, added, import_id)
        facts.append((name, stored_rows))
        produced.append(_per_file(rows, "n"))
        written.append(_per_file(stored_rows, "n"))
    store.index_sessions(facts, import_id)

    def total(parts: list[DataFrame], name: str) -> DataFrame:
        counted = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return counted.groupBy("file_sha256").agg(F.sum("n").alias(name))

    missing = result.missing_info.groupBy("file_sha256").agg(
        F.sum("n_missing").alias("missing_info_count")
    )
    zero = F.lit(0).cast("long")

    def count(name: str) -> Column:
        return F.coalesce(name, zero).alias(name)

    batch = (
        files.join(_per_file(records, "record_count"), "file_sha256", "left")
        .join(total(produced, "_produced"), "file_sha256", "left")
        .join(total(written, "imported_count"), "file_sha256", "left")
        .join(_per_file(rejects, "rejected_count"), "file_sha256", "left")
        .join(missing, "file_sha256", "left")
        .select(
            F.lit(mapping.source_name).alias("source_name"),
            "file_sha256",
            F.element_at(F.split("file_path", "/"), -1).alias("original_filename"),
            "file_format",
            F.lit(mapping.name).alias("mapping_name"),
            F.lit("succeeded").alias("status"),
            F.lit(moment).alias("imported_at"),
            count("record_count"),
            count("imported_count"),
            (F.coalesce("_produced", zero) - F.coalesce("imported_count", zero)).alias(
                "duplicate_count"
            ),
            count("rejected_count"),
            count("missing_info_count"),
        )
    )
    store.append("import_batch", batch, import_id)
    store.commit(import_id)


# --------------------------------------------------------------------- reports


def display_status(status: Column, rejected: Column) -> Column:
    """failed; partial while running or with rejects; else completed."""
    return (
        F.when(status == "failed", "failed")
        .when(status.isin("pending", "running") | (rejected > 0), "partial")
        .otherwise("completed")
    )


def report(batches: DataFrame) -> DataFrame:
    """Per-file report of import batches."""
    return batches.withColumn(
        "display_status", display_status(F.col("status"), F.col("rejected_count"))
    )


def total_report(reports: DataFrame) -> DataFrame:
    """One row over several files: summed counters, the worst status."""
    sums = [
        F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
        for c in (
            "record_count",
            "imported_count",
            "duplicate_count",
            "rejected_count",
            "missing_info_count",
        )
    ]
    status = (
        F.when(F.bool_or(F.col("display_status") == "failed"), "failed")
        .when(F.bool_or(F.col("display_status") == "partial"), "partial")
        .otherwise("completed")
    )
    return reports.agg(F.count("*").alias("files"), *sums, status.alias("display_status"))


__all__ = ["FACT_KEYS", "TABLES", "Warehouse", "file_ledger", "ingest", "report", "total_report"]
