"""Helpers the operators of this subpackage share: ordering, hot keys, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.cluster import cut_lineage, shared_dir

#: What a broadcast hint may weigh, by measured bytes.
BROADCAST_BYTES = 32 << 20
_POSITION_BITS = 33  # monotonically_increasing_id() puts the partition above these


def send(spark: SparkSession, value):
    """Broadcast ``value`` with the code of its classes; ``received`` unpacks it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    """The value behind ``send``, built anew in each task."""
    return cloudpickle.loads(sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(
    df: DataFrame, keys: Sequence[str | Column], label: str, staged: bool = True
) -> DataFrame:
    """``df`` range-sorted by ``keys`` and written, with ``_at`` and ``_block``.

    ``_at`` grows along the order; ``_block`` is the sorted piece a row lies in. Range
    partitions split equal leading keys when later keys differ, so no group decides the size
    of a piece. The sorted table is written: positions can't change when a task runs again.
    The range sort reads its input twice; unless that is a plain scan, ``staged`` writes it.
    """
    source = cut_lineage(df, f"{label}-rows") if staged else df
    by = [F.col(k) if isinstance(k, str) else k for k in keys]
    done = (
        source.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return cut_lineage(done, f"{label}-sorted").withColumn(
        "_block", F.shiftright("_at", _POSITION_BITS)
    )


def block_starts(df: DataFrame) -> list[tuple[int, int]]:
    """``(block, rows in earlier blocks)`` for each block of an ordered table.

    One entry per written piece, whatever the number of rows.
    """
    counts = sorted(
        (r[0], r[1]) for r in df.groupBy("_block").agg(F.count("*")).collect()
    )
    starts, total = [], 0
    for block, n in counts:
        starts.append((block, total))
        total += n
    return starts


def row_number0(df: DataFrame) -> Column:
    """Gapless position from 0 of a row of an ordered table."""
    starts = block_starts(df)
    within = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    if not starts:
        return F.lit(0).cast("long")
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return within + F.element_at(offsets, F.col("_block"))


def measured_bytes(df: DataFrame, row_bytes: int) -> int:
    """Rows of ``df`` times an upper bound for a row."""
    return df.count() * row_bytes


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint when the measured size of ``df`` is small; else ``df`` as it is."""
    return F.broadcast(df) if measured_bytes(df, row_bytes) <= BROADCAST_BYTES else df


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, add: str) -> DataFrame:
    """``rows`` with column ``add`` of their group; ``groups`` has one row per key.

    ``weight`` is the group's number of rows. Groups with over a thousandth of all rows, of
    which there are fewer than a thousand by arithmetic, are broadcast, so a hot group never
    meets in one task; all others are joined by a shuffle. Keys must not be NULL.
    """
    total = groups.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = groups.where(F.col(weight) * 1000 > total).select(
        key, F.lit(True).alias("_hot"), F.col(add).alias("_hot_value")
    )
    marked = rows.join(F.broadcast(hot), key, "left")
    met = marked.where("_hot").withColumn(add, F.col("_hot_value"))
    cold = groups.where(F.col(weight) * 1000 <= total).select(key, add)
    rest = marked.where("_hot IS NULL").join(cold, key)
    keep = [*rows.columns, add]
    return met.select(*keep).unionByName(rest.select(*keep))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, dropped: DataFrame, key: str, row_bytes: int = 16) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``dropped``; broadcast only if that is small."""
    gone = unused(df, "_gone")
    names = dropped.select(F.col(key).alias(gone)).distinct()
    names = cut_lineage(names, "dropped")
    return df.join(
        maybe_broadcast(names, row_bytes), F.col(key).eqNullSafe(F.col(gone)), "left_anti"
    )


def carried(df: DataFrame, group: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier blocks of the row's group, as column ``name``.

    Only groups that reach over the edge of a block need a carry: at most two rows per
    block, which is what is broadcast.
    """
    totals = df.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_blocks", F.count("*").over(whole))
        .where("_blocks > 1")
        .select(
            *[F.col(g).alias(f"_c_{g}") for g in group],
            F.col("_block").alias("_c_block"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(name),
        )
    )
    on = F.col("_block") == F.col("_c_block")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    joined = df.join(F.broadcast(carry), on, "left")
    return joined.select(*df.columns, F.coalesce(name, F.lit(0)).alias(name))


__all__ = [
    "attach",
    "block_starts",
    "carried",
    "cut_lineage",
    "maybe_broadcast",
    "measured_bytes",
    "ordered",
    "received",
    "row_number0",
    "send",
    "shared_dir",
    "table",
    "unused",
    "without",
]
