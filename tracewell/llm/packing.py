"""Best-fit packing into sequences of several permitted lengths.

Pieces are placed longest first. A piece goes where the least room would be left; where no open
bin has room, bins are opened whose size costs least for each token that the remaining pieces
can fill. In the end every bin shrinks to the smallest permitted length that holds its contents.
Among all sets of permitted lengths that bins may be opened with, the set of least total cost
wins, so the lengths are chosen jointly.

Lengths are small whole numbers, so the packing of any number of pieces is decided on the
histogram of lengths: all pieces of a length are placed in a few runs of equal steps. The runs
are applied by each piece's rank within its length, which comes from one range sort.

Defined cases: a NULL length counts as 0 and every document ends with one separator token, so
each has a piece; a document longer than the largest permitted length is cut into pieces of
that length and a rest; repeated rows are packed one by one; other columns are not looked at;
an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import ordered, received, row_number0, send

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a bin besides its tokens, in tokens.
BIN_COST = 32


@dataclass
class Plan:
    """Runs ``(length, rank, n, bin, each, offset)`` and bins ``(bin, n, size)``.

    In a run, pieces of ``length`` from ``rank`` on fill bins from ``bin`` on, ``each`` to a
    bin, side by side from ``offset``. Bins ``bin`` to ``bin + n`` have one size.
    """

    runs: list[tuple[int, int, int, int, int, int]]
    bins: list[tuple[int, int, int]]
    cost: int


def _contents(
    length: int, left: dict[int, int], order: list[int], size: int
) -> dict[int, int]:
    """What one bin of ``size`` takes, longest first from ``length`` on: pieces by length."""
    room, taken = size, {}
    at = bisect.bisect_left(order, -length)
    while at < len(order) and room:
        own = -order[at]
        n = min(left[own], room // own)
        if n:
            taken[own] = n
            room -= own * n
        at = max(at + 1, bisect.bisect_left(order, -room))
    return taken


def _least_cost(
    length: int, left: dict[int, int], order: list[int], sizes: Sequence[int], bin_cost: int
) -> tuple[int, dict[int, int], int]:
    """The size of least cost per token, its contents, and for how many bins that holds.

    The choice can't change while every length still has as many pieces as any size would take.
    """
    fills = {s: _contents(length, left, order, s) for s in sizes if s >= length}

    def rate(size: int) -> tuple[float, int]:
        return (size + bin_cost) / sum(x * n for x, n in fills[size].items()), size

    size = min(fills, key=rate)
    most = {x: max(f.get(x, 0) for f in fills.values()) for x in fills[size]}
    same = min((left[x] - most[x]) // n for x, n in fills[size].items())
    return size, fills[size], same + 1


def best_fit(
    histogram: dict[int, int], sizes: Sequence[int], permitted: Sequence[int], bin_cost: int
) -> Plan:
    """Best-fit decreasing; bins open with one of ``sizes``, then shrink to ``permitted``.

    Each bin's size is chosen on its own, by the pieces that earlier bins are not expected to
    take; bins whose choice must be the same are opened together.
    """
    order = sorted((-length for length in histogram if length > 0))
    left = dict(histogram)
    free = dict(histogram)  # pieces that no open bin is expected to take
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, size)
    heap_of = []  # sorted rooms
    next_bin = 0

    def put(room: int, piece: tuple[int, int, int]) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(heap_of, room)
        heapq.heappush(rooms[room], piece)

    for minus in order:
        length, rank = -minus, 0
        while left[length]:
            at = bisect.bisect_left(heap_of, length)
            if at == len(heap_of):
                free[length] = left[length]
                size, taken, n = _least_cost(length, free, order, sizes, bin_cost)
                for own, count in taken.items():
                    free[own] -= n * count
                put(size, (next_bin, n, size))
                next_bin += n
                continue
            room = heap_of[at]
            first, n, size = heapq.heappop(rooms[room])
            each = room // length
            used = min(n, -(-left[length] // each))
            pieces = min(left[length], used * each)
            if used > 1 and pieces < used * each:
                used -= 1
                pieces = used * each
            runs.append((length, rank, pieces, first, each, size - room))
            put(room - min(each, pieces) * length, (first, used, size))
            if used < n:
                heapq.heappush(rooms[room], (first + used, n - used, size))
            if not rooms[room]:
                del rooms[room]
                heap_of.pop(bisect.bisect_left(heap_of, room))
            rank += pieces
            left[length] -= pieces
    bins, cost = [], 0
    for room, own in rooms.items():
        for first, n, size in own:
            if room == size:
                continue  # opened for the rest of a length but never used
            fits = min(p for p in permitted if p >= size - room)
            bins.append((first, n, fits))
            cost += n * (fits + bin_cost)
    return Plan(runs, sorted(bins), cost)


def plan(histogram: dict[int, int], permitted: Sequence[int], bin_cost: int = BIN_COST) -> Plan:
    """The cheapest packing over all sets of sizes to open bins with."""
    permitted = sorted(permitted)
    *others, largest = permitted
    sets = itertools.chain.from_iterable(
        itertools.combinations(others, k) for k in range(len(others) + 1)
    )
    plans = [best_fit(histogram, (*s, largest), permitted, bin_cost) for s in sets]
    return min(plans, key=lambda p: p.cost)


def word_count(text: Column) -> Column:
    """Whitespace-separated words of a text: the token count used where none is given."""
    return F.coalesce(
        F.size(F.split(F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")), " "))
        - (F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")) == "").cast("int"),
        F.lit(0),
    )


def pieces(docs: DataFrame, doc_id: str, length: Column, largest: int) -> DataFrame:
    """``doc_id, piece, start, length`` of every document, separator included."""
    total = (F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)) + 1).cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), total.alias("_total"))
    last = F.ceil(F.col("_total") / largest).cast("int") - 1
    cut = sized.select("doc_id", "_total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return cut.select(
        "doc_id",
        "piece",
        start.alias("start"),
        F.least(F.lit(largest), F.col("_total") - start).cast("int").alias("length"),
    )


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, runs, bin_firsts, bin_sizes = received(sent)
        for batch in batches:
            nth = batch.column("nth").to_numpy()
            run_of = np.searchsorted(starts, nth, "right") - 1
            own = runs[run_of]
            k = nth - starts[run_of]
            bin_id = own[:, 1] + k // own[:, 2]
            offset = own[:, 3] + (k % own[:, 2]) * own[:, 0]
            size = bin_sizes[np.searchsorted(bin_firsts, bin_id, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(bin_id), pa.array(size), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "bin_id", "bin_size", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    length: Column | None = None,
    permitted: Sequence[int] = LENGTHS,
    bin_cost: int = BIN_COST,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, bin_id, bin_size, offset``.

    ``length`` is a document's number of tokens; by default the words of ``text``.
    """
    spark = docs.sparkSession
    tokens = word_count(F.col("text")) if length is None else length
    rows = ordered(
        pieces(docs, doc_id, tokens, max(permitted)),
        [F.desc("length"), "doc_id", "piece"],
        "pack-pieces",
    )
    counted = rows.groupBy("length").count().collect()  # at most the largest length rows
    chosen = plan({r[0]: r[1] for r in counted}, permitted, bin_cost)
    # Runs come longest first and by rank, as the rows are sorted: the run's start is its sum.
    runs = np.array([r for r in chosen.runs] or [(1, 0, 0, 0, 1, 0)], np.int64)
    starts = np.cumsum(runs[:, 2]) - runs[:, 2]
    bins = np.array(chosen.bins or [(0, 0, 0)], np.int64)
    sent = send(spark, (starts, runs[:, [0, 3, 4, 5]], bins[:, 0], bins[:, 2]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(
        "doc_id", "piece", "start", "length", row_number0(rows).alias("nth")
    ).mapInArrow(
        _assign(sent),
        f"doc_id {kind}, piece int, start long, length int, "
        "bin_id long, bin_size long, offset long",
    )
