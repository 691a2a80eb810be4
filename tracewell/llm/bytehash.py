"""Hashes of byte ranges, for whole Arrow batches of texts at once.

A range is hashed from prefix sums of ``table[byte] * base ** position`` modulo 2 ** 64, so any
number of ranges, overlapping or not, costs one pass over the bytes and two look-ups a range.
Equal bytes have equal hashes wherever they stand.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits depend on all bytes."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@cache
def _constants(seed: int) -> tuple[int, np.ndarray]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62, 1 << 63)) | 5
    return base, rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; a worker keeps the longest."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        base = _constants(seed)[0]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n + n // 8, b & _MASK, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        _POWERS[seed] = (out[0], out[1])
    return _POWERS[seed]


class Ranges:
    """Hashes of ranges of ``data`` (uint8) under one seed."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        up, self._down = _powers(seed, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        terms = _constants(seed)[1][data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each ``data[start:end]``."""
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def every(self, width: int) -> np.ndarray:
        """Hash of each range of ``width`` bytes."""
        n = len(self._sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mixed((self._sums[width:] - self._sums[:n]) * self._down[:n])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, data)`` of a string or binary column; NULLs are empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return at - at[0], body[at[0] : at[-1]]


def spread(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``first, first + 1, …`` for each of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - ends + lengths, lengths)
