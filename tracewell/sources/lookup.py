"""Selective reads: rows of wanted keys, and price lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.cluster import broadcast_if_small

_PRICES = (
    "prices array<struct<model_name:string,input_usd_per_mtok:double,"
    "output_usd_per_mtok:double,cached_usd_per_mtok:double>>"
)


def keyed_lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted.

    The smallest and largest wanted key become a pushed-down range, so row groups outside it
    are skipped; the semi join then reads only what is left.
    """
    wanted = keys.select(key).distinct()
    bounds = wanted.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if bounds.lo is None:
        return rows.where("false")
    inside = rows.where(F.col(key).between(bounds.lo, bounds.hi))
    return inside.join(broadcast_if_small(wanted), key, "left_semi")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price list document: ``{"prices": [{model_name, input..., output..., cached...}]}``."""
    document = spark.read.schema(_PRICES).json(path, multiLine=True)
    return document.select(F.inline("prices"))
