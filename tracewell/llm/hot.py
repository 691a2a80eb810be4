"""Joins and numbering that no single key can hold up, for operators over hash keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import ordered

#: Keys with over one in so many rows are hot; there are fewer of them than this, by arithmetic.
HOT_SHARE = 1000
SALTS = 64


def meet(rows: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Rows of ``rows`` whose key is in ``groups``, with ``_salt``; neither key is NULL.

    ``groups`` is a written table with one row per key and its number of rows as ``weight``.
    Rows of a hot key are dealt over ``SALTS`` sub-keys, its one row in ``groups`` is repeated
    for each, so the rows are read and shuffled once. The columns of ``groups`` other than
    keys and weight are added.
    """
    total = groups.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * HOT_SHARE > total
    hot = F.broadcast(groups.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
    others = [c for c in rows.columns if c not in keys]
    dealt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")
    own = rows.join(hot, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot"), dealt).otherwise(F.lit(0))
    )
    last = F.when(is_hot, F.lit(SALTS - 1)).otherwise(F.lit(0))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop(weight)
    return own.drop("_hot").join(copies, [*keys, "_salt"])


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; any key may hold most of the rows.

    Sub-keys are cut first, so the last step sees at most ``SALTS * n`` rows of a key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    by_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    some = salted.withColumn("_nth", F.row_number().over(by_salt)).where(F.col("_nth") <= n)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        some.drop("_salt")
        .withColumn("_nth", F.row_number().over(by_key))
        .where(F.col("_nth") <= n)
        .drop("_nth")
    )


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, doc_id, text``: ``doc`` is a whole number that orders the documents.

    Ids that are whole numbers, present and unique serve as they are. Otherwise documents are
    numbered by id (NULL last), then by digest of the text: rows of one id with different texts
    are different documents, rows alike in both are one document and get the same number.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    whole = dict(own.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    clash = own.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if whole and clash.isEmpty():
        return own.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    names = own.select(F.col("doc_id").alias("_id"), digest.alias("_digest")).distinct()
    order = names.select(F.col("_id").isNull().alias("_no_id"), "_id", "_digest")
    number = ordered(order, ["_no_id", "_id", "_digest"], "documents").select(
        F.col("_at").alias("doc"), "_id", "_digest"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
    return own.join(number, same).select("doc", "doc_id", "text")
