"""The tables an import writes: commits, membership of sessions, compaction.

An import writes all its rows under its own ``import_id`` partition and publishes them with one
row of the ``commit`` table. Commits are numbered; a number is claimed by creating a file that
must not exist yet, so of several writers each gets a number of its own. A commit may replace
earlier imports, which is how many small imports become few sorted files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import schemas
from tracewell.cluster import cut_lineage
from tracewell.operators.store import insert_ignore, register_dimension, upsert_overwrite

#: One row per session an import added rows for, and per fact table: the membership index.
SESSION_INDEX = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("session_hash", T.LongType()),
    ]
)
TABLES: dict[str, T.StructType] = {
    "session": schemas.SESSION,
    "model_call": schemas.MODEL_CALL,
    "tool_call": schemas.TOOL_CALL,
    "raw_record": schemas.RAW_STORED,
    "import_reject": schemas.REJECT,
    "import_batch": schemas.IMPORT_BATCH,
    "field_profile": schemas.FIELD_PROFILE,
    "repository": schemas.REPOSITORY,
    "session_index": SESSION_INDEX,
}
FACT_KEYS = {
    "session": schemas.SESSION_KEY,
    "model_call": schemas.CALL_KEY,
    "tool_call": schemas.CALL_KEY,
}
#: Files of a table are sorted by these, so that ranges in Parquet footers exclude files.
_SORTED_BY = {
    "session": ["source_name", "external_id"],
    "model_call": ["source_name", "external_id", "sequence"],
    "tool_call": ["source_name", "external_id", "sequence"],
    "raw_record": ["file_sha256", "record_index"],
    "import_reject": ["file_sha256", "record_index"],
    "import_batch": ["source_name", "file_sha256"],
    "field_profile": ["file_sha256", "path"],
    "repository": ["source_name", "name"],
    "session_index": ["table_name", "session_hash"],
}
_COMMIT = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("import_id", T.StringType()),
        T.StructField("replaces", T.ArrayType(T.StringType())),
    ]
)
_PRICE_VERSION = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("folder", T.StringType())]
)
#: Values pushed into a scan as a list at most; more are joined. The rows are the same.
PUSHED = 1000


class CommitRefused(RuntimeError):
    """Another writer committed first."""


def session_hash() -> Column:
    """What the membership index knows a session by."""
    return F.xxhash64("source_name", "external_id")


@dataclass(frozen=True)
class Warehouse:
    """Tables below one folder that every executor can reach."""

    spark: SparkSession
    path: str

    # -- files ---------------------------------------------------------------------------

    def _stored(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _claim(self, log: str, version: int) -> bool:
        """Whether this writer got the number; the file is created only if it is not there."""
        fs, target = self._hadoop(f"{self.path}/{log}/_claims/{version:012d}")
        fs.mkdirs(target.getParent())
        return fs.createNewFile(target)

    def _newest(self, log: str) -> int:
        """Highest claimed number, 0 before the first."""
        fs, folder = self._hadoop(f"{self.path}/{log}/_claims")
        if not fs.exists(folder):
            return 0
        # Names are numbers of twelve digits: the claims are listed, no data is read.
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder)), default=0)

    # -- commits -------------------------------------------------------------------------

    def version(self) -> int:
        """Number of the newest commit."""
        return self._newest("commit")

    def commits(self) -> DataFrame:
        """Ids of the visible imports, one row per import run: committed and not replaced."""
        log = self._stored("commit", _COMMIT)
        gone = log.select(F.explode("replaces").alias("import_id"))
        return log.select("import_id").distinct().join(gone, "import_id", "left_anti")

    def commit(
        self, import_id: str, replaces: Sequence[str] = (), after: int | None = None
    ) -> int:
        """Publish an import; returns its number.

        With ``after`` the commit must be the next one after that number, and is refused if
        another writer came first. Without, it takes the next free number.
        """
        number = (self.version() if after is None else after) + 1
        while not self._claim("commit", number):
            if after is not None:
                raise CommitRefused(f"commit {number} belongs to another writer")
            number += 1
        row = self.spark.createDataFrame([(number, import_id, list(replaces))], _COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commit")
        return number

    def table(self, name: str) -> DataFrame:
        """Committed rows of a table. The imports are joined, so no list of them is collected."""
        return self._visible(name).drop("import_id")

    def _visible(self, name: str) -> DataFrame:
        schema = T.StructType([*TABLES[name].fields, T.StructField("import_id", T.StringType())])
        rows = self._stored(name, schema)
        return rows.join(self.commits(), "import_id", "left_semi")

    def append(self, name: str, rows: DataFrame, import_id: str) -> DataFrame:
        """Write rows under an import; they stay invisible until it is committed."""
        columns = [f.name for f in TABLES[name].fields]
        target = f"{self.path}/{name}/import_id={import_id}"
        rows.select(*columns).write.mode("overwrite").parquet(target)
        return self.spark.read.schema(TABLES[name]).parquet(target)

    # -- membership ----------------------------------------------------------------------

    def index_sessions(self, parts: Sequence[tuple[str, DataFrame]], import_id: str) -> None:
        """Note for which sessions an import adds rows to which fact table."""
        named = [
            rows.select(F.lit(name).alias("table_name"), session_hash().alias("session_hash"))
            for name, rows in parts
        ]
        every = named[0]
        for part in named[1:]:
            every = every.unionByName(part)
        ordered = every.distinct().sortWithinPartitions(*_SORTED_BY["session_index"])
        self.append("session_index", ordered, import_id)

    def rows_of_sessions(self, name: str, sessions: DataFrame) -> DataFrame:
        """Committed rows of a fact table that may belong to ``sessions``.

        ``sessions`` has ``source_name, external_id``. The narrow index tells which imports hold
        a row of one of them; only those partitions are read, and of a small batch only files
        whose footers admit one of its sessions. An import of new sessions reads no fact row.
        """
        batch = cut_lineage(
            sessions.select("source_name", "external_id").distinct().withColumn(
                "session_hash", session_hash()
            ),
            "batch-sessions",
        )
        few = [r for r in batch.limit(PUSHED + 1).collect()]
        index = self._visible("session_index").where(F.col("table_name") == name)
        if len(few) <= PUSHED:
            index = index.where(F.col("session_hash").isin([r.session_hash for r in few]))
        hits = index.join(batch.select("session_hash"), "session_hash", "left_semi")
        # Imports from before commits were numbered have no index: they may hold anything.
        old = self._stored("commit", _COMMIT).where("version IS NULL").select("import_id")
        hits = hits.select("import_id").union(old).join(self.commits(), "import_id", "left_semi")
        hits = cut_lineage(hits.distinct(), "batch-imports")
        named = [r.import_id for r in hits.limit(PUSHED + 1).collect()]
        rows = self._stored(
            name,
            T.StructType([*TABLES[name].fields, T.StructField("import_id", T.StringType())]),
        )
        if len(named) <= PUSHED:
            rows = rows.where(F.col("import_id").isin(named))
        else:
            rows = rows.join(hits, "import_id", "left_semi")
        if len(few) <= PUSHED:
            rows = rows.where(F.col("external_id").isin(sorted({r.external_id for r in few})))
        return rows.drop("import_id")

    def not_stored(self, name: str, batch: DataFrame, order: list[Column]) -> DataFrame:
        """The batch's rows to append: first of each natural key that is not stored yet."""
        return insert_ignore(self.rows_of_sessions(name, batch), batch, FACT_KEYS[name], order)

    # -- compaction ----------------------------------------------------------------------

    def compact(self, max_imports: int = 1000, rows_per_file: int = 5_000_000) -> int | None:
        """Rewrite up to ``max_imports`` visible imports as one with few, sorted files.

        Readers see the old files until the one commit row that names what it replaces, and
        the same rows after it. If another writer commits in between, the compaction is
        refused (``CommitRefused``) and nothing changes. Returns the number of its commit, or
        None when fewer than two imports are visible.
        """
        base = self.version()
        old = [r.import_id for r in self.commits().orderBy("import_id").limit(max_imports).collect()]
        if len(old) < 2:
            return None
        import_id = uuid.uuid4().hex
        for name in TABLES:
            schema = T.StructType(
                [*TABLES[name].fields, T.StructField("import_id", T.StringType())]
            )
            rows = self._stored(name, schema).where(F.col("import_id").isin(old))
            rows = rows.drop("import_id")
            if name == "session_index":
                rows = rows.distinct()
            files = max(1, -(-rows.count() // rows_per_file))
            by = _SORTED_BY[name]
            self.append(name, rows.repartitionByRange(files, *by).sortWithinPartitions(*by), import_id)
        return self.commit(import_id, replaces=old, after=base)

    def vacuum(self) -> int:
        """Delete the files of replaced imports; returns the number of folders deleted.

        To be called when no reader that started before the compaction is left.
        """
        gone = self._stored("commit", _COMMIT).select(F.explode("replaces").alias("import_id"))
        deleted = 0
        for row in gone.distinct().toLocalIterator():
            for name in TABLES:
                fs, folder = self._hadoop(f"{self.path}/{name}/import_id={row.import_id}")
                deleted += fs.exists(folder) and fs.delete(folder, True)
        return deleted

    # -- price lists, dimensions, profiles -----------------------------------------------

    def prices(self) -> DataFrame:
        """The current price list: the table named by the newest price commit."""
        return self._prices_at(self._stored("price_version", _PRICE_VERSION))

    def _prices_at(self, versions: DataFrame) -> DataFrame:
        folder = versions.agg(F.max_by("folder", "version").alias("folder")).first().folder
        if folder is None:
            return self.spark.createDataFrame([], schemas.MODEL_PRICING)
        return self.spark.read.schema(schemas.MODEL_PRICING).parquet(f"{self.path}/{folder}")

    def put_prices(self, batch: DataFrame) -> DataFrame:
        """Insert or replace prices by model name; the new list is written beside the old.

        If another writer publishes a list meanwhile, the batch is merged anew with that one.
        """
        while True:
            base = self._newest("price_version")
            folder = f"model_pricing/{uuid.uuid4().hex}"
            merged = upsert_overwrite(self.prices(), batch, ["model_name"])
            merged.write.parquet(f"{self.path}/{folder}")
            if self._claim("price_version", base + 1):
                row = self.spark.createDataFrame([(base + 1, folder)], _PRICE_VERSION)
                row.coalesce(1).write.mode("append").parquet(f"{self.path}/price_version")
                return self.prices()

    def register_repositories(self, batch: DataFrame) -> DataFrame:
        """Idempotent registration; returns total, registered and skipped."""
        wide = batch
        for column in ("url", "language"):
            if column not in batch.columns:
                wide = wide.withColumn(column, F.lit(None).cast("string"))
        new, counts = register_dimension(
            self.table("repository"), wide, ["source_name", "name"]
        )
        counts = cut_lineage(counts, "registration")
        import_id = uuid.uuid4().hex
        self.append("repository", new, import_id)
        self.commit(import_id)
        return counts

    def put_profile(self, profile: DataFrame) -> None:
        """Store field profiles, first one wins per file and path."""
        batch = profile.select(
            F.col("file_key").alias("file_sha256"), *[c for c in profile.columns if c != "file_key"]
        )
        new = insert_ignore(
            self.table("field_profile"), batch, ["file_sha256", "path"], [F.col("inferred_type")]
        )
        import_id = uuid.uuid4().hex
        self.append("field_profile", new, import_id)
        self.commit(import_id)
