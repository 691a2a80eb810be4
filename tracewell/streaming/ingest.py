"""Files arriving in a folder, imported as they come with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.ingest import Warehouse, ingest
from tracewell.plans.mapping import Mapping

_FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(
    spark: SparkSession,
    folder: str,
    mapping: Mapping,
    store: Warehouse,
    checkpoint: str,
    files_per_batch: int = 1000,
    file_format: str | None = None,
) -> StreamingQuery:
    """Import every file not seen yet, then stop.

    The stream carries file names only. A batch that is run again after a failure finds its
    files in the ledger, so nothing is imported twice.
    """
    arriving = (
        spark.readStream.format("binaryFile")
        .schema(_FILE)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(F.col("_metadata.file_path").alias("file_path"))
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        names = [r.file_path for r in batch.collect()]  # bounded by files_per_batch
        if names:
            ingest(batch.sparkSession, names, mapping, store, file_format=file_format)

    return (
        arriving.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
