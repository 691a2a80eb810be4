from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.cluster import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def raw_of(spark):
    """Raw-record frame from Python objects; a string is an unparseable record."""
    from pyspark.sql import functions as F

    def build(records, file_key="file-1"):
        rows = []
        for index, record in enumerate(records):
            broken = isinstance(record, str)
            text = None if broken else json.dumps(record)
            rows.append((file_key, index, f"sha-{index}", text, record if broken else None))
        df = spark.createDataFrame(
            rows,
            "file_key string, record_index long, record_sha256 string, j string, "
            "parse_error string",
        )
        return df.select(
            "file_key",
            "record_index",
            "record_sha256",
            F.try_parse_json("j").alias("payload"),
            "parse_error",
        )

    return build


def values(df, *columns, order=None):
    chosen = df.select(*columns) if columns else df
    rows = [tuple(r) for r in chosen.collect()]
    return sorted(rows, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
