"""Joins of rows with a table of keys in which a few keys hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ranking import order_columns

#: Keys with over one in so many rows are hot; there are fewer of them than this, by arithmetic.
HOT_SHARE = 1000
SALTS = 64


def join_spread(
    rows: DataFrame, described: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """``rows`` joined with ``described``, which has one row per key, without a hot task.

    ``how`` is inner, left or left_semi. Rows of a hot key are dealt over ``SALTS`` sub-keys and
    the key's one row in ``described`` is repeated for each of them, so both sides are shuffled
    once whatever the key's share. Rows with a NULL key match nothing and are dealt out as well.
    The keys are counted first, combined on the map side and read without the other columns.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    hot = F.broadcast(
        counts.where(F.col("_n") * HOT_SHARE > total).select(*keys, F.lit(True).alias("_hot"))
    )
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    dealt = F.pmod(F.xxhash64(*order_columns(rows)), F.lit(SALTS)).cast("int")
    own = rows.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | blank, dealt).otherwise(F.lit(0))
    )
    last = F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(F.lit(0))
    copies = described.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), last))
    )
    return own.drop("_hot").join(copies.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
