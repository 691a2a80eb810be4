"""Exact order statistics, top-n and numbering that never gather one hot group in a task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_BITS = 20


def select_by_rank(
    df: DataFrame, value: Column, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Exact order statistics of an integer column, one row, one column per requested rank.

    Each rank maps the number of non-NULL values to a 0-based position in sorted order.
    The values are first counted per distinct value (combined before the shuffle), then per
    bucket of 2**20 neighbouring values. Only the bucket totals and the values of the
    buckets that hold a requested position are ever ordered, so no task sorts the column:
    milliseconds over a century make three million buckets, and one bucket holds at most
    2**20 distinct values.
    """
    counted = (
        df.select(value.cast("long").alias("v"))
        .where("v IS NOT NULL")
        .groupBy("v")
        .agg(F.count("*").alias("c"))
    )
    counted = counted.withColumn("bucket", F.shiftright("v", _BUCKET_BITS))
    buckets = counted.groupBy("bucket").agg(F.sum("c").alias("bc"))
    ordered = buckets.select(
        "bucket",
        (F.sum("bc").over(Window.orderBy("bucket")) - F.col("bc")).alias("before"),
        "bc",
        F.sum("bc").over(Window.partitionBy()).alias("n"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("pos"))
            for name, rank in ranks.items()
        ]
    )
    targets = (
        ordered.select("bucket", "before", "bc", F.inline(wanted))
        .where("before <= pos AND pos < before + bc")
        .select("name", "bucket", (F.col("pos") - F.col("before")).alias("offset"))
    )
    # One row per requested rank: a bound fixed by the caller's code, not by the data.
    inside = counted.join(F.broadcast(targets), "bucket")
    upto = F.sum("c").over(Window.partitionBy("name").orderBy("v"))
    picked = inside.select("name", "v", "c", "offset", upto.alias("upto")).where(
        "upto - c <= offset AND offset < upto"
    )
    return picked.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ranks])


def median(df: DataFrame, value: Column, name: str = "median") -> DataFrame:
    """Exact median (mean of the middle two) of an integer column as a one-row frame."""
    middle = select_by_rank(
        df,
        value,
        {
            "lo": lambda n: F.floor((n - 1) / 2),
            "hi": lambda n: F.floor(n / 2),
        },
    )
    return middle.select(((F.col("lo") + F.col("hi")) / 2.0).alias(name))


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 64
) -> DataFrame:
    """First ``n`` rows of every group in the given total order.

    Spark prunes each map partition to ``n`` rows per group for small ``n``. Beyond its
    threshold the group is first split over ``salts`` sub-groups, so the last step sees at
    most ``n * salts`` rows of one group.
    """
    if n > 1000:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_columns(df)), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
        df = df.drop("_salt", "_rn")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def order_columns(df: DataFrame) -> list[Column]:
    """Columns usable as a hash input (everything but variants and maps)."""
    skipped = ("variant", "map")
    return [F.col(name) for name, dtype in df.dtypes if not dtype.startswith(skipped)]


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key; map tasks drop later copies before the shuffle."""
    return top_n_per_group(df, keys, order, 1)


def running_number(
    df: DataFrame, keys: list[str], position: str, order: list[Column], name: str,
    span: int = 65536,
) -> DataFrame:
    """0-based ordinal of each row inside its group, in ``order``.

    ``position`` is an integer column that leads the order. Groups are cut into blocks of
    ``span`` positions: rows are numbered inside a block and shifted by the number of rows
    in earlier blocks, so a group holding a third of the table is spread over many tasks.
    Key columns must not be NULL.
    """
    block = "_block"
    df = df.withColumn(block, F.floor(F.col(position) / span).cast("long"))
    per_block = df.groupBy(*keys, block).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy(block)
    offsets = per_block.select(
        *keys, block, (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_before")
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    matched = numbered.join(offsets, [*keys, block])
    return matched.withColumn(name, F.col("_inside") - 1 + F.col("_before")).drop(
        block, "_inside", "_before"
    )
