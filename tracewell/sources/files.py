"""File listing, fingerprints and formats."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted suffixes and the format each stands for.
SUFFIXES = {".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".parquet": "parquet"}
_CHUNK = 8 * 1024 * 1024


class UnsupportedFormat(ValueError):
    """A file whose suffix names no readable format."""


def detect_format(path: str) -> str:
    """Format of a file by its suffix; a trailing ``.gz`` is looked through for JSON lines."""
    name = path.rsplit("/", 1)[-1].lower()
    plain = name.removesuffix(".gz")
    for suffix, kind in SUFFIXES.items():
        if plain.endswith(suffix) and (plain == name or kind == "jsonl"):
            return kind
    raise UnsupportedFormat(f"{path}: accepted suffixes are {', '.join(sorted(SUFFIXES))}")


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_path, length)`` of every file below the paths; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.select(F.col("_metadata.file_path").alias("file_path"), "length").distinct()


def open_stream(path: str):
    """A readable stream of a file from inside a task, for any filesystem Arrow knows."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(unquote(urlparse(path).path))
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_stream(inner)


def _digest(path: str) -> str:
    digest = hashlib.sha256()
    with open_stream(path) as stream:
        while chunk := stream.read(_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(file_sha256=[_digest(path) for path in batch["file_path"]])


def file_fingerprints(files: DataFrame) -> DataFrame:
    """``files`` with ``file_sha256`` over all bytes.

    A file is hashed by one task in 8 MiB pieces, so its size is not limited by memory or by
    the 2 GiB a binary cell can hold.
    """
    spark = files.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", file_sha256 string"
    return files.repartition(tasks, "file_path").mapInPandas(_hash_batches, schema)


def _footer_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        errors, schemas = [], []
        for path in batch["file_path"]:
            try:
                if urlparse(path).scheme in ("", "file"):
                    schema = pq.read_schema(unquote(urlparse(path).path))
                else:
                    filesystem, inner = fs.FileSystem.from_uri(path)
                    schema = pq.read_schema(inner, filesystem=filesystem)
                errors.append(None)
                schemas.append(schema.remove_metadata().to_string())
            except Exception as error:  # any unreadable footer becomes an error record
                errors.append(f"invalid Parquet file: {error}")
                schemas.append(None)
        yield batch.assign(error=errors, file_schema=schemas)


def parquet_footers(files: DataFrame) -> DataFrame:
    """``files`` with the footer's schema as text, or the error it gives."""
    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes)
    return files.repartition("file_path").mapInPandas(
        _footer_batches, f"{schema}, error string, file_schema string"
    )


# The batch functions travel with their tasks, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
