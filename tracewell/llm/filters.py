"""Set filters of a fixed size, so that what is sent to tasks does not grow with the data."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** 27 bits are 16 MB.
FILTER_BITS = 27
_SEGMENT_BITS = 21


def _probes(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return key >> np.uint64(64 - bits), key & np.uint64((1 << bits) - 1)


class Filter:
    """A bit per probe; ``has`` may say yes to a key that was never added, but never no to one that was."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.zeros(1 << (bits - 6), np.uint64)

    def __getstate__(self) -> tuple[int, bytes]:
        # Sent compressed: most bits of a filter are zero until it is nearly full.
        return self.bits, zlib.compress(self.slots.tobytes(), 1)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.bits = state[0]
        self.slots = np.frombuffer(zlib.decompress(state[1]), np.uint64)

    def has(self, key: np.ndarray) -> np.ndarray:
        found = np.ones(len(key), bool)
        for p in _probes(key, self.bits):
            found &= (self.slots[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)) > 0
        return found

    def with_keys(self, keys: DataFrame) -> Filter:
        """A filter that has the one column of ``keys``, mixed 64-bit hashes, as well.

        Bits are put together in tasks; the driver gets the filter in pieces of 256 KB.
        """
        high = F.shiftrightunsigned(keys.columns[0], 64 - self.bits)
        low = F.col(keys.columns[0]).bitwiseAND((1 << self.bits) - 1)
        probe = keys.select(F.explode(F.array(high, low)).alias("p"))
        bit = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
        words = probe.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(bit).alias("bits"))
        size = 1 << min(self.bits, _SEGMENT_BITS) - 6

        def build(table: pa.Table) -> pa.Table:
            slots = table.column("slot").to_numpy()
            piece = np.zeros(size, np.int64)
            piece[slots % size] = table.column("bits").to_numpy()
            return pa.table({"segment": [int(slots[0]) // size], "bits": [piece.tobytes()]})

        pieces = (
            words.withColumn("segment", F.expr(f"slot DIV {size}"))
            .groupBy("segment")
            .applyInArrow(build, "segment long, bits binary")
        )
        joined = Filter(self.bits)
        joined.slots = self.slots.copy()
        for row in pieces.toLocalIterator():
            mine = slice(row["segment"] * size, (row["segment"] + 1) * size)
            joined.slots[mine] |= np.frombuffer(row["bits"], np.uint64)
        return joined
