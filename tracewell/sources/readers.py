"""Scans of JSONL, CSV and Parquet files into one raw-record table.

Every reader yields ``file_path, record_index, record_sha256, payload, parse_error``: one row
per physical record, bad ones included, numbered from 0 inside their file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.cluster import configure, cut_lineage
from tracewell.schemas import RAW_RECORD
from tracewell.sources.csv_scan import BOM, scan_csv
from tracewell.sources.files import detect_format, file_fingerprints, list_files, parquet_footers

COLUMNS = [f.name for f in RAW_RECORD.fields]
#: What a broadcast split table may weigh.
BROADCAST_BYTES = 32 << 20
# Texts of parse errors, and the fingerprint of no bytes at all.
EMPTY_LINE = "empty JSONL line"
INVALID_JSON = "invalid JSON"
NOT_AN_OBJECT = "JSONL record must be an object"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def number_rows(scan: DataFrame, **per_split: Column) -> tuple[DataFrame, DataFrame]:
    """Add ``file_path`` and the 0-based ``record_index`` of each row inside its file.

    A file is read as splits by many tasks. Rows are counted per split, the counts are added
    up along the file, and each row gets its split's offset plus its place in the split. The
    split table has a row per 128 MB of input by default. It is broadcast, so that the text
    itself is never shuffled, if its measured bytes allow, and joined otherwise.
    Returns the numbered rows and the split table with the ``per_split`` aggregates.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = tagged.groupBy("file_path", "_start").agg(
        F.min("_id").alias("_first"),
        F.count("*").alias("_rows"),
        *[value.alias(name) for name, value in per_split.items()],
    )
    along = Window.partitionBy("file_path").orderBy("_start")
    offsets = cut_lineage(
        splits.withColumn("_before", F.sum("_rows").over(along) - F.col("_rows")), "splits"
    )
    starts = offsets.select("file_path", "_start", "_first", "_before")
    weight = starts.agg(F.sum(F.length("file_path") + 64).alias("w")).first().w or 0
    small = F.broadcast(starts) if weight <= BROADCAST_BYTES else starts
    joined = tagged.join(small, ["file_path", "_start"], "left")
    # A row whose split is unknown means the files changed between the two reads.
    changed = F.raise_error(F.lit("input files changed while they were read"))
    index = F.coalesce(F.col("_before") + F.col("_id") - F.col("_first"), changed.cast("long"))
    return (
        joined.withColumn("record_index", index).drop("_start", "_id", "_first", "_before"),
        offsets,
    )


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Physical lines; only ``\\n`` ends a line (the default also breaks at a lone ``\\r``)."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.rtrim("value", F.lit("\r")).alias("value"), "_metadata")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def parse_line(line: Column) -> tuple[Column, Column]:
    """(payload, parse_error) of one JSONL line."""
    text = F.ltrim(line, F.lit(BOM))
    parsed = F.try_parse_json(F.when(F.is_valid_utf8(line), text))
    is_object = F.regexp_like(text, F.lit(r"^[ \t]*\{"))
    error = (
        F.when(F.regexp_like(line, F.lit(r"^[ \t\r\x0B\f]*$")), EMPTY_LINE)
        .when(parsed.isNull(), INVALID_JSON)
        .when(~is_object, NOT_AN_OBJECT)
    )
    return F.when(is_object, parsed), error


def read_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One record per line, plain or gzip-compressed. A bad line becomes an error record."""
    configure(spark)
    numbered, _ = number_rows(_lines(spark, paths))
    payload, error = parse_line(F.col("value"))
    return numbered.select(
        "file_path",
        "record_index",
        _sha(F.col("value")).alias("record_sha256"),
        payload.alias("payload"),
        error.alias("parse_error"),
    )


# ------------------------------------------------------------------------- CSV


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV with a header per file; all values are strings; a bad row is an error record.

    Every file has its own dialect, guessed from its first characters, and all files are read
    by the same three scans of their splits, whatever their headers. Blank lines are rows
    without values and keep their number. Files and splits are tables, never driver lists.
    """
    configure(spark)
    records, refused = scan_csv(spark, paths)
    return _union(spark, [records, _refused(refused)])


def _refused(files: DataFrame) -> DataFrame:
    """One error record for each file (``file_path, parse_error``) that cannot be read."""
    return file_fingerprints(files).select(
        "file_path",
        F.lit(0).cast("long").alias("record_index"),
        F.col("file_sha256").alias("record_sha256"),
        F.lit(None).cast("variant").alias("payload"),
        "parse_error",
    )


# --------------------------------------------------------------------- Parquet


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Typed records; files are grouped by schema, unreadable ones give one error record."""
    configure(spark)
    footers = parquet_footers(list_files(spark, paths)).collect()  # one row per file
    by_schema: dict[str, list[str]] = {}
    parts = []
    for footer in footers:
        if footer.error is None:
            by_schema.setdefault(footer.file_schema, []).append(footer.file_path)
    for files in by_schema.values():
        scan = spark.read.parquet(*files)
        payload = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in scan.columns]))
        rows = scan.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.row_index").alias("record_index"),
            payload.alias("payload"),
        )
        parts.append(
            rows.select(
                "file_path",
                "record_index",
                _sha(F.to_json("payload")).alias("record_sha256"),
                "payload",
                F.lit(None).cast("string").alias("parse_error"),
            )
        )
    broken = [(f.file_path, f.error) for f in footers if f.error is not None]
    if broken:
        listed = spark.createDataFrame(broken, "file_path string, parse_error string")
        parts.append(
            listed.select(
                "file_path",
                F.lit(0).cast("long").alias("record_index"),
                F.lit(EMPTY_SHA256).alias("record_sha256"),
                F.lit(None).cast("variant").alias("payload"),
                "parse_error",
            )
        )
    return _union(spark, parts)


# ------------------------------------------------------------------ any format

READERS = {"jsonl": read_jsonl, "csv": read_csv, "parquet": read_parquet}


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], RAW_RECORD)
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def read_any(
    spark: SparkSession, paths: list[str], file_format: str | None = None
) -> DataFrame:
    """Records of all files below the paths, each read by its suffix or as ``file_format``."""
    files = [r.file_path for r in list_files(spark, paths).collect()]  # names only
    groups: dict[str, list[str]] = {}
    for file in sorted(files):
        groups.setdefault(file_format or detect_format(file), []).append(file)
    return _union(spark, [READERS[kind](spark, group) for kind, group in groups.items()])
