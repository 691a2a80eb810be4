"""Contiguous shards of least largest size, in DataFrame functions only.

Equal texts form atomic groups. Groups stand in the order of their text digest, which mixes
sources evenly and needs no join back: a document knows its place from its own digest. The
smallest capacity for which a greedy walk over the ordered group sizes needs no more than the
allowed shards is found by binary search, and the order is cut there.

The walk reads a tree of block sums, not the groups: a block is opened, by one small query for
all blocks in question, only while a probe depends on what is inside. The driver holds some
thousand sums at any corpus size.

Defined cases: a NULL text is an empty one and shares its group; its size is 1. Repeated rows
are rows of one group. Fewer groups than shards leave shards empty; an empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import cut_lineage, ordered, row_number0

SHARDS = 16
_TOP = 1024  # blocks that the walk starts with, about
_FAN = 6  # bits: pieces of an opened block


class Tree:
    """Ordered block sums with pieces opened on demand.

    ``split(blocks)`` returns the pieces ``(first, bits, rows, bytes)`` of each block, in order;
    a block covers positions ``first`` to ``first + 2**bits``.
    """

    def __init__(self, blocks: list[tuple[int, int, int, int]], split) -> None:
        self.blocks = sorted(blocks)
        self.split = split
        self._sum()

    def _sum(self) -> None:
        self.ends, total = [], 0
        for b in self.blocks:
            total += b[3]
            self.ends.append(total)
        self.total = total

    def open(self, numbers: set[int]) -> None:
        chosen = [self.blocks[i] for i in sorted(numbers)]
        rest = [b for i, b in enumerate(self.blocks) if i not in numbers]
        self.blocks = sorted(rest + self.split(chosen))
        self._sum()

    def feasible(self, capacity: int, shards: int) -> bool:
        """Whether greedy filling up to ``capacity`` needs ``shards`` shards at most.

        The walk runs with a lower and an upper bound of each cut; blocks that hold the
        difference are opened until both agree on the answer.
        """
        while True:
            low = high = 0
            doubtful: set[int] = set()
            for _ in range(shards):
                low, at_low = self._reach(low + capacity, whole=True)
                high, at_high = self._reach(high + capacity, whole=False)
                doubtful |= {i for i in (at_low, at_high) if i is not None}
            if low >= self.total:
                return True
            if high < self.total or not doubtful:
                return False
            self.open(doubtful)

    def _reach(self, target: int, whole: bool) -> tuple[int, int | None]:
        """Farthest cut not beyond ``target`` bytes, and the block to open to know better."""
        if target >= self.total:
            return self.total, None
        i = bisect.bisect_right(self.ends, target)  # the block that goes beyond the target
        start = self.ends[i - 1] if i else 0
        if self.blocks[i][2] <= 1 or start == target:
            return start, None
        return (start if whole else target), i

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Position of the first group of each shard but the first."""
        while True:
            at, doubtful, firsts = 0, set(), []
            for _ in range(shards):
                at, inside = self._reach(at + capacity, whole=True)
                if inside is not None:
                    doubtful.add(inside)
                    break
                if at >= self.total:
                    break
                firsts.append(self.blocks[bisect.bisect_right(self.ends, at)][0])
            if not doubtful:
                return firsts
            self.open(doubtful)


def smallest_capacity(tree: Tree, shards: int, largest: int) -> int:
    """Least feasible capacity by binary search."""
    low = max(largest, -(-tree.total // shards))
    high = max(low, -(-tree.total // shards) + largest)  # always feasible
    while low < high:
        mid = (low + high) // 2
        if tree.feasible(mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def _block(bits: int) -> Column:
    return F.shiftleft(F.shiftright("_at", bits), bits)


def _tree(groups: DataFrame) -> tuple[Tree, int]:
    """Tree over the ordered ``groups`` (``_at``, ``bytes``) and the largest group."""
    stats = groups.agg(F.count("*"), F.coalesce(F.max("bytes"), F.lit(0))).first()
    n, largest = stats
    bits = max(0, (n // _TOP).bit_length())

    def sums(rows: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        grouped = rows.groupBy(_block(bits).alias("first")).agg(
            F.count("*").alias("n"), F.sum("bytes").alias("bytes")
        )
        return [(r[0], bits, r[1], r[2]) for r in grouped.collect()]

    def split(blocks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        found = []
        for bits in sorted({b[1] for b in blocks}):
            own = [b[0] for b in blocks if b[1] == bits]
            inside = groups.where(
                _block(bits).isin(own) & F.col("_at").between(min(own), max(own) + (1 << bits))
            )
            found += sums(inside, max(0, bits - _FAN))
        return found

    return Tree(sums(groups, bits), split), largest


def minimax_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """Every document with its shard: ``doc_id, size, text_crc32, digest, shard, slot``.

    ``slot`` counts a shard's documents from 0 in the order of digest and id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    measured = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.sha2(body, 256).alias("digest"),
    )
    rows = ordered(measured, ["digest", "doc_id"], "shard-docs")
    sizes = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = ordered(sizes, ["digest"], "shard-groups")
    tree, largest = _tree(groups)
    capacity = smallest_capacity(tree, shards, largest)
    firsts = tree.cuts(capacity, shards)
    edges = [
        r[0] for r in groups.where(F.col("_at").isin(firsts)).select("digest").collect()
    ]
    shard = F.lit(0)
    for edge in edges:
        shard = shard + (F.col("digest") >= edge).cast("int")
    placed = cut_lineage(
        rows.select("*", row_number0(rows).alias("_nth"), shard.alias("shard")), "shard-placed"
    )
    begins = {
        r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_nth")).collect()
    }
    if not begins:
        return placed.select(*_COLUMNS[:5], F.col("_nth").alias("slot"))
    start = F.element_at(F.create_map(*[F.lit(x) for p in begins.items() for x in p]), F.col("shard"))
    return placed.select(*_COLUMNS[:5], (F.col("_nth") - start).alias("slot"))


_COLUMNS = ("doc_id", "size", "text_crc32", "digest", "shard", "slot")
