"""A key with a third of all rows is dealt over many tasks, and no row is lost or doubled."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from conftest import values
from pyspark.sql import functions as F

from tracewell.functions.joins import join_spread
from tracewell.operators.normalise import link_model_calls


@contextmanager
def fixed_shuffle(spark, partitions=32):
    """Shuffled joins with as many tasks as asked for, none merged or split at run time."""
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(partitions),
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def calls(spark, n=6000):
    """A third of the rows in session 0, a third without one, the rest one by one."""
    session = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 1, F.col("id"))
    return spark.range(n).select(F.col("id").alias("sequence"), session.alias("session"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_and_missing_keys(spark, how):
    rows = calls(spark)
    described = spark.range(0, 6000, 2).select(F.col("id").alias("session"), F.lit("x").alias("d"))
    with fixed_shuffle(spark):
        got = join_spread(rows, described, ["session"], how)
        assert largest_task(got) < 6000 / 8
        plain = rows.join(described, ["session"], how)
        assert largest_task(plain) >= 6000 / 3
        assert values(got) == values(plain)
        assert got.columns == plain.columns


def test_tool_calls_without_a_model_call_sequence(spark):
    """Session 0 has a third of the tool calls, most of them naming no model call."""
    tools = calls(spark).where("session IS NOT NULL").select(
        "session", "sequence", F.when(F.col("sequence") < 30, F.col("sequence")).alias("model_call_sequence")
    )
    models = spark.range(0, 30, 3).select(F.lit(0).cast("long").alias("session"), F.col("id").alias("sequence"))
    with fixed_shuffle(spark):
        linked = link_model_calls(tools, models, ["session"])
        assert largest_task(linked) < 4000 / 8
        assert (linked.count(), linked.where("has_model_call").count()) == (4000, 10)


def test_empty_tables(spark):
    rows, none = calls(spark, 3), calls(spark, 0)
    described = none.select("session", F.lit(1).alias("d"))
    assert join_spread(rows, described, ["session"]).count() == 0
    assert join_spread(rows, described, ["session"], "left").count() == 3
    assert join_spread(none, described, ["session"]).count() == 0
