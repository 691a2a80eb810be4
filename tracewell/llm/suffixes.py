"""Repeated byte windows by a depth-limited radix sort of the suffixes.

Suffixes are told apart only through ``threshold`` bytes, most significant digit first. After
each digit those alone in their group are dropped, so later digits see few suffixes; groups
still together at full depth are exactly the repeated windows.

The bytes of a window are compared in an order that lets neighbours travel together. The first
digit is the window's *anchor*: the ``k`` bytes with the smallest hash inside it (leftmost of
ties). Some 70 suffixes in a row share an anchor and make one row, a piece. The next digits
widen the anchor to both sides, for blocks of ever fewer offsets, until one offset is left and
the digit is the whole window. In every group pieces that agree as a whole are settled at once:
all but the first are repeated, and only the first goes on to the next digit.

Digits are 64-bit hashes; pieces agree if 64 bits of another hash agree as well. Which anchors
are repeated, and which pieces go on, is told to tasks by filters of a fixed size, so text is
shuffled once only, at the end; a false hit costs a row and changes nothing. Digits are counted
with map-side combining, and digits with many rows are dealt over sub-keys. The removed
stretches of a document are gathered by document; there are no more of them than it has bytes.

Defined cases: a NULL text is empty; texts shorter than the threshold have no windows; ids that
are NULL, repeated or no whole numbers are ordered as ``hot.numbered`` says, and rows alike in
id and text are one document and get equal results; texts of any length are hashed in portions;
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.bytehash import Ranges, bytes_of, mixed, spread
from tracewell.llm.filters import FILTER_BITS, Filter
from tracewell.llm.hot import meet, numbered
from tracewell.llm.shared import cut_lineage, received, send

THRESHOLD = 100
_PORTION = 1 << 18  # window starts hashed at once; positions in a portion need 20 bits
_LOW = np.uint64((1 << 20) - 1)
_DIGIT, _WHOLE = 1, 2  # seeds

_PIECES = "core long, whole long, doc long, at long"


def _anchor_bytes(threshold: int) -> int:
    return max(1, threshold * 32 // 100)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    signed = [pa.array(c.view(np.int64)) for c in columns.values()]
    return pa.RecordBatch.from_arrays(signed, names=list(columns))


class _Portion:
    """The pieces of one portion of a batch: stretches of window starts with one anchor.

    ``core`` is the anchor's hash, ``place`` its position, ``high`` and ``low`` how far the
    first and the last window start lie before it.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, at: int, threshold: int) -> None:
        k = _anchor_bytes(threshold)
        width = threshold - k + 1
        first = np.maximum(offsets[:-1], at)
        n = np.maximum(np.minimum(offsets[1:] - threshold + 1, at + _PORTION) - first, 0)
        starts, doc = spread(first, n) - at, np.repeat(np.arange(len(n)), n)
        self.threshold = threshold
        self.bytes = data[at : at + _PORTION + threshold - 1]
        digits = Ranges(self.bytes, _DIGIT).every(k)
        least = digits & ~_LOW | np.arange(len(digits), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least[starts] & _LOW).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new))[: len(begin)] - 1
        self.place, self.doc = anchor[begin], doc[begin]
        self.high, self.low = self.place - starts[begin], self.place - starts[end]
        self.core = digits[self.place]
        self.at = (self.place + at - offsets[self.doc]) << 20 | self.high << 10 | self.low

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("place", "doc", "high", "low", "core", "at"):
            setattr(self, name, getattr(self, name)[chosen])

    def whole(self) -> np.ndarray:
        """Hash of all bytes of a piece and of where its anchor lies in it."""
        ends = self.place - self.low + self.threshold
        shape = (self.at & int(_LOW)).view(np.uint64)
        return mixed(Ranges(self.bytes, _WHOLE).of(self.place - self.high, ends) ^ mixed(shape))

    def bodies(self) -> pa.Array:
        start = self.place - self.high
        size = self.place - self.low + self.threshold - start
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        body = self.bytes[spread(start, size)]
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(body)]
        return pa.Array.from_buffers(pa.binary(), len(size), buffers)


def _portions(batches: Iterator[pa.RecordBatch], threshold: int):
    """``(ids of the batch, portion)`` for documents given as ``doc, text``."""
    for batch in batches:
        offsets, data = bytes_of(batch.column(1))
        ids = batch.column(0).to_numpy()
        for at in range(0, len(data) - threshold + 1, _PORTION):
            yield ids, _Portion(offsets, data, at, threshold)


def _anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, portion in _portions(batches, threshold):
            yield _batch(core=portion.core)

    return run


def _anchored_pieces(threshold: int, repeated):
    """Pieces whose anchor is (but for false hits) repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among: Filter = received(repeated)
        for ids, portion in _portions(batches, threshold):
            portion.keep(among.has(portion.core))
            doc = ids[portion.doc]
            yield _batch(core=portion.core, whole=portion.whole(), doc=doc, at=portion.at)

    return run


def _place_key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc.view(np.uint64)) ^ at.view(np.uint64))


def _place_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch(key=_place_key(*(batch.column(c).to_numpy() for c in ("doc", "at"))))


def _bytes_of_pieces(threshold: int, wanted):
    """Pieces that stand in the filter, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among: Filter = received(wanted)
        for ids, portion in _portions(batches, threshold):
            portion.keep(among.has(_place_key(ids[portion.doc], portion.at)))
            columns = _batch(core=portion.core, doc=ids[portion.doc], at=portion.at)
            yield columns.append_column("body", portion.bodies())

    return run


def _narrower_pieces(threshold: int, width: int):
    """Pieces cut at multiples of ``width`` offsets; the digit is what a whole block shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, doc, at = (batch.column(i).to_numpy() for i in range(3))
            begin, data = bytes_of(batch.column(3))
            digits, wholes = Ranges(data, _DIGIT), Ranges(data, _WHOLE)
            high, low = at >> 10 & 1023, at & 1023
            place = begin[:-1] + high  # the bytes begin at the widest offset
            blocks = high // width - low // width + 1
            piece = np.repeat(np.arange(len(at)), blocks)
            block = spread(low // width, blocks)
            top = np.minimum(high[piece], block * width + width - 1)
            bottom = np.maximum(low[piece], block * width)
            base = block * width
            limit = np.minimum(base + width - 1, threshold - _anchor_bytes(threshold))
            digit = digits.of(place[piece] - base, place[piece] + threshold - limit)
            digit = mixed(digit ^ mixed(core[piece].view(np.uint64) + block.astype(np.uint64)))
            shape = top << 10 | bottom
            whole = wholes.of(place[piece] - top, place[piece] + threshold - bottom)
            whole = mixed(whole ^ mixed(shape.astype(np.uint64)))
            yield _batch(
                core=digit, whole=whole, doc=doc[piece], at=at[piece] >> 20 << 20 | shape
            )

    return run


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = bytes_of(batch.column("text"))
            lists = batch.column("flagged")
            bounds = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            packed = lists.flatten().to_numpy()
            spans, kept = [], []
            for i in range(len(batch)):
                body = data[offsets[i] : offsets[i + 1]]
                mine = np.sort(packed[bounds[i] : bounds[i + 1]])
                start = mine >> 20
                end = np.maximum.accumulate(start + (mine & int(_LOW)) + threshold - 1)
                apart = np.flatnonzero(start[1:] > end[:-1])
                starts = np.concatenate([start[:1], start[apart + 1]]).tolist()
                found = list(zip(starts, np.concatenate([end[apart], end[-1:]]).tolist()))
                edges = [0, *(x for span in found for x in span), len(body)]
                spans.append([{"start": s, "end": e} for s, e in found])
                kept.append(b"".join(body[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(spans, _SPAN_TYPE),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def _settle(cores: DataFrame, pieces: Callable, label: str) -> tuple[DataFrame, DataFrame]:
    """``(copies, open)`` after one digit.

    ``cores`` holds the digit of every piece; ``pieces`` gives the pieces, those with a digit
    found once need not be among them. ``copies`` agree as a whole with an earlier piece;
    ``open`` are the first of their kind in groups that hold several kinds.
    """
    groups = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    groups = cut_lineage(groups, f"{label}-digits")
    together = meet(pieces(groups), groups, ["core"], "n")
    # A kind is numbered within its sub-key first, so no kind is too large for a task.
    nth = F.row_number().over(Window.partitionBy("core", "_salt", "whole").orderBy("doc", "at"))
    staged = together.withColumn("repeat", nth > 1).select(
        *[F.when(~F.col("repeat"), F.col(c)).alias(c) for c in ("core", "whole")],
        "doc",
        "at",
        "repeat",
    )
    staged = cut_lineage(staged, f"{label}-together")
    nth = F.row_number().over(Window.partitionBy("core", "whole").orderBy("doc", "at"))
    some = staged.where("NOT repeat").withColumn("repeat", nth > 1)
    some = cut_lineage(some, f"{label}-kinds")
    firsts = some.where("NOT repeat").drop("repeat")
    kinds = firsts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    kinds = cut_lineage(kinds, f"{label}-open")
    still = meet(firsts, kinds, ["core"], "n").select("core", "doc", "at")
    copies = staged.where("repeat").union(some.where("repeat")).select("doc", "at")
    return copies, still


def _widths(threshold: int) -> list[int]:
    """Offsets in a block of each later digit."""
    span = threshold - _anchor_bytes(threshold) + 1
    return sorted({-(-span // 3), -(-span // 18), 1}, reverse=True)


def _ranges(pieces: DataFrame) -> DataFrame:
    """Anchored pieces as ``doc, flagged``: first window start and number of windows, packed."""
    high, low = F.shiftright("at", 10).bitwiseAND(1023), F.col("at").bitwiseAND(1023)
    lo = F.shiftright("at", 20) - high
    return pieces.select("doc", (F.shiftleft(lo, 20) + high - low + 1).alias("flagged"))


def repeated_windows(
    docs: DataFrame, threshold: int = THRESHOLD, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``doc, flagged``: stretches of windows with an equal window earlier on.

    ``docs`` has ``doc`` (a whole number that orders the documents) and ``text``. ``flagged``
    packs the first window start, in bytes, above 20 bits of the number of windows.
    """
    if not 2 <= threshold <= 1000:
        raise ValueError("threshold must lie between 2 and 1000 bytes")
    spark = docs.sparkSession
    texts = docs.select("doc", "text")

    def sent(keys: DataFrame):
        return send(spark, Filter(filter_bits).with_keys(keys))

    def anchored(groups: DataFrame) -> DataFrame:
        return texts.mapInArrow(_anchored_pieces(threshold, sent(groups.select("core"))), _PIECES)

    anchors = texts.mapInArrow(_anchors(threshold), "core long")
    copies, still = _settle(anchors, anchored, "suffixes-1")
    found = _ranges(copies)
    keys = still.select("doc", "at").mapInArrow(_place_keys, "key long")
    with_bytes = _bytes_of_pieces(threshold, sent(keys))
    pieces = cut_lineage(
        texts.mapInArrow(with_bytes, "core long, doc long, at long, body binary"),
        "suffixes-1-bytes",
    )
    for depth, width in enumerate(_widths(threshold), 2):
        narrow = pieces.mapInArrow(_narrower_pieces(threshold, width), _PIECES)
        copies, still = _settle(narrow.select("core"), lambda _: narrow, f"suffixes-{depth}")
        found = found.union(_ranges(copies))
        if width > 1:
            pieces = _narrowed(pieces, still, threshold, f"suffixes-{depth}-bytes")
    return found


def _narrowed(pieces: DataFrame, still: DataFrame, threshold: int, label: str) -> DataFrame:
    """The pieces still open, with their bytes cut out of the wider pieces they come from."""
    place = F.shiftright("at", 20)
    wide = pieces.select("doc", place.alias("place"), F.col("at").alias("wide"), "body")
    # Each wide piece lies alone at its anchor, so this key is unique on the wide side.
    joined = still.withColumn("place", place).join(wide, ["doc", "place"])
    high = F.shiftright("wide", 10).bitwiseAND(1023)
    own_high, own_low = F.shiftright("at", 10).bitwiseAND(1023), F.col("at").bitwiseAND(1023)
    inside = (own_high <= high) & (own_low >= F.col("wide").bitwiseAND(1023))
    start = (high - own_high + 1).cast("int")
    size = (own_high - own_low + threshold).cast("int")
    body = F.col("body").substr(start, size).alias("body")
    return cut_lineage(joined.where(inside).select("core", "doc", "at", body), label)


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: documents without bytes that repeat earlier ones.

    A byte goes if a window of ``threshold`` bytes over it also starts earlier: in a document of
    smaller id, or earlier in the same one. ``spans`` are the maximal removed ranges, end
    exclusive; ``kept`` is what is left, as bytes, since a cut may fall into a character.
    """
    rows = numbered(docs, doc_id, text)
    found = cut_lineage(repeated_windows(rows, threshold), "suffixes-flagged")
    lists = found.groupBy("doc").agg(F.collect_list("flagged").alias("list"))
    lists = cut_lineage(lists.withColumnRenamed("doc", "_doc"), "suffixes-lists")
    none = F.array().cast("array<long>")
    marked = rows.join(lists, F.col("doc") == F.col("_doc"), "left").select(
        "doc_id", "text", F.coalesce("list", none).alias("flagged")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(
        _cut(threshold),
        f"doc_id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary",
    )
