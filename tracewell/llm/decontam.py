"""Benchmark decontamination with a distributed positional inverted index.

Building reads the training texts once and stores token postings: each task turns its
documents into segments of about a million words and writes, for every segment, its terms with
their positions. A document lies whole in one segment, so no posting is ever shuffled and no
term is hot. Searching reads segments only: for each test phrase the position list of its
rarest term in the segment is taken, moved by the term's offset in the phrase and intersected
with the lists of the next rarer terms until nothing or the exact matches are left.

Test items reach the executors in blocks of bounded bytes; each block is one pass over the
index, never over the texts.

Defined cases: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a
NULL or wordless text has no words and no hits; an item without words is no item; repeated
documents give a row each; repeated items count once by id; a NULL item id counts as the empty
string. Empty tables give empty results. Other columns of either table are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.cluster import scratch_path
from tracewell.llm.shared import received, send, without

WINDOW = 10
SEGMENT_WORDS = 1 << 20
#: Test items sent to the executors at once, in bytes of text.
BLOCK_BYTES = 4 << 20
_CANDIDATES = 1 << 22  # positions intersected at once


def _table() -> bytes:
    """Byte to byte: A-Z to lower case, all but word bytes to a blank."""
    word = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    lower = {b: b + 32 for b in range(0x41, 0x5B)}
    return bytes(lower.get(b, b if b in word else 0x20) for b in range(256))


_WORDS = _table()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return text.encode().translate(_WORDS).split() if text else []


# -- index ---------------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """uint32 values by byte planes; the mostly zero planes cost next to nothing on disk."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)


class _Segment:
    """Documents gathered until the segment is full."""

    def __init__(self) -> None:
        self.ids: list = []
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.next = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.next)
        self.lengths.append(len(words))
        self.terms.append(
            np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        )
        self.next += len(words) + 1  # the gap keeps phrases inside a document

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        terms = np.concatenate(self.terms)
        lengths = np.array(self.lengths, np.int64)
        positions = np.arange(len(terms)) + np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(self.vocabulary))
        gaps = np.diff(positions[order], prepend=0)
        first = np.cumsum(counts) - counts
        gaps[first] = positions[order][first]
        columns = [
            [number],
            [self.ids],
            [self.starts],
            [self.lengths],
            [b" ".join(self.vocabulary)],
            [_packed(counts)],
            [_packed(gaps)],
        ]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _builder(id_type: pa.DataType, segment_words: int):
    schema = pa.schema(
        [
            ("segment", pa.int64()),
            ("ids", pa.list_(id_type)),
            ("starts", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())),
            ("terms", pa.binary()),
            ("counts", pa.binary()),
            ("postings", pa.binary()),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        segment = _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment.add(doc_id, words_of(text.as_py()))
                if segment.next >= segment_words:
                    yield segment.row(number, schema)
                    number += 1
                    segment = _Segment()
        if segment.ids:
            yield segment.row(number, schema)

    return build


def build_index(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    segment_words: int = SEGMENT_WORDS,
) -> None:
    """Write the index of ``docs`` to ``path``: one row per segment, one pass, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    schema = (
        f"segment long, ids array<{kind.simpleString()}>, starts array<long>, "
        "lengths array<long>, terms binary, counts binary, postings binary"
    )
    narrow.mapInArrow(_builder(to_arrow_type(kind), segment_words), schema).write.option(
        "compression", "zstd"
    ).parquet(path)


# -- search --------------------------------------------------------------------------------


class _Postings:
    """A segment ready for lookups."""

    def __init__(self, row: dict) -> None:
        self.lookup = dict(zip(row["terms"].split(), range(1 << 62)))
        self.counts = _unpacked(row["counts"])
        self.first = np.cumsum(self.counts) - self.counts
        gaps = np.cumsum(_unpacked(row["postings"]))
        base = np.where(self.first > 0, gaps[self.first - 1], 0) if len(gaps) else self.first
        self.positions = gaps - np.repeat(base, self.counts)
        #: Sorted, since terms are numbered upward and positions grow within a term.
        self.keys = (np.repeat(np.arange(len(self.counts)), self.counts) << 32) | self.positions

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each term stands at its position."""
        wanted = (terms << 32) | np.maximum(positions, 0)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (positions >= 0)

    def starts_of(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(phrase row, start)`` of every occurrence of phrases of known terms."""
        rarest_first = np.argsort(self.counts[phrases], axis=1, kind="stable")
        rows = np.arange(len(phrases))
        anchor = phrases[rows, rarest_first[:, 0]]
        n = self.counts[anchor]
        which = np.repeat(rows, n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        starts = self.positions[self.first[anchor][which] + nth] - rarest_first[which, 0]
        for k in range(1, phrases.shape[1]):
            offset = rarest_first[which, k]
            alive = self.has(phrases[which, offset], starts + offset)
            which, starts = which[alive], starts[alive]
            if not len(which):
                break
        whole = starts >= 0
        return which[whole], starts[whole]

    def phrases(self, vocabulary: np.ndarray, windows: np.ndarray):
        """Occurrences of windows (rows of vocabulary numbers), in bounded portions."""
        local = vocabulary[windows]
        possible = np.flatnonzero((local >= 0).all(axis=1))
        if not len(possible) or not len(self.keys):
            return
        load = np.cumsum(self.counts[local[possible]].min(axis=1))
        cuts = np.searchsorted(load, np.arange(_CANDIDATES, load[-1] + 1, _CANDIDATES)) + 1
        for part in np.split(possible, np.unique(cuts)):
            if len(part):
                which, starts = self.starts_of(local[part])
                yield part[which], starts

    def near(self, terms: list[int], span: int) -> list[tuple[int, int]]:
        """Smallest stretches of at most ``span`` words that hold all ``terms``."""
        rarest = min(terms, key=lambda t: self.counts[t])
        anchors = self._list(rarest)
        events = []
        for t in terms:
            own = self._list(t)
            at = np.searchsorted(anchors, own)
            left = np.abs(own - anchors[np.maximum(at - 1, 0)])
            right = np.abs(anchors[np.minimum(at, len(anchors) - 1)] - own)
            close = own[np.minimum(left, right) < span]
            events += [(int(p), t) for p in close]
        last: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        for p, t in sorted(events):
            last[t] = p
            if len(last) == len(terms):
                start = min(last.values())
                if p - start < span and (not found or start > found[-1][0]):
                    found.append((start, p + 1))
        return found

    def _list(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term] + self.counts[term]]


class _Items:
    """A block of test items as windows over one vocabulary."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], window: int) -> None:
        self.names = sorted({r[0] for r in rows})
        number = {name: i for i, name in enumerate(self.names)}
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.sets: list[tuple[int, list[int]]] = []
        for name, text in rows:
            ids = [words[w] for w in text]
            if ids:
                self.sets.append((number[name], sorted(set(ids))))
                for a in range(max(1, len(ids) - window + 1)):
                    owners[tuple(ids[a : a + window])].add(number[name])
        self.vocabulary = list(words)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in owners:
            by_length[len(w)].append(w)
        self.groups = [
            (np.array(ws, np.int64), [sorted(owners[w]) for w in ws])
            for _, ws in sorted(by_length.items())
        ]

    def local(self, postings: _Postings) -> np.ndarray:
        get = postings.lookup.get
        return np.array([get(w, -1) for w in self.vocabulary] or [-1], np.int64)


def _doc_spans(mask: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """``(document number, start, end)`` of the marked stretches, counted from its start."""
    edges = np.diff(mask.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(starts, begin, "right") - 1
    return doc, begin - starts[doc], end - starts[doc]


def _searcher(block, matches_only: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = received(block)
        for batch in batches:
            for row in batch.to_pylist():
                postings = _Postings(row)
                starts, lengths = np.array(row["starts"]), np.array(row["lengths"])
                cover = np.zeros(int(starts[-1] + lengths[-1]) + 2, np.int32)
                found: dict[int, set[int]] = defaultdict(set)
                local = items.local(postings)
                for windows, owners in items.groups:
                    for which, at in postings.phrases(local, windows):
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + windows.shape[1], -1)
                        doc = np.searchsorted(starts, at, "right") - 1
                        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                            found[d].update(owners[w])
                doc, begin, end = _doc_spans(np.cumsum(cover) > 0, starts, lengths)
                spans: dict[int, list] = defaultdict(list)
                for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist()):
                    spans[d].append({"start": a, "end": b})
                kept = sorted(found) if matches_only else range(len(starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(kept), pa.int64()),
                        pa.array(list(kept), pa.int64()),
                        pa.array(
                            [row["ids"][d] for d in kept], batch.schema.field("ids").type.value_type
                        ),
                        pa.array([row["lengths"][d] for d in kept], pa.int64()),
                        pa.array([spans[d] for d in kept], _SPANS),
                        pa.array(
                            [[items.names[i] for i in found[d]] for d in kept],
                            pa.list_(pa.string()),
                        ),
                    ],
                    names=["segment", "nth", "doc_id", "n_words", "spans", "items"],
                )

    return search


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int):
    """Test items in blocks; the driver holds one block at a time."""
    rows: list[tuple[str, list[bytes]]] = []
    held = 0
    chosen = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), text)
    for name, body in chosen.toLocalIterator():
        if words := words_of(body):
            rows.append((name, words))
            held += len(body)
            if held >= block_bytes:
                yield _Items(rows, window)
                rows, held = [], 0
    yield _Items(rows, window)


def phrase_matches(
    index: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For every indexed document: ``doc_id, n_words, spans, items``.

    ``spans`` are the word ranges (start, exclusive end) that lie in an occurrence of any
    window of ``window`` consecutive item words; ``items`` are the ids whose windows occur.
    """
    spark = index.sparkSession
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    schema = (
        f"segment long, nth long, doc_id {id_type}, n_words long, "
        "spans array<struct<start: long, end: long>>, items array<string>"
    )
    parts = []
    for block in _blocks(items, item_id, text, window, block_bytes):
        sent = send(spark, block)
        parts.append(index.mapInArrow(_searcher(sent, bool(parts)), schema))
    if len(parts) == 1:
        return parts[0].drop("segment", "nth")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return (
        every.groupBy("segment", "nth")
        .agg(
            F.any_value("doc_id").alias("doc_id"),
            F.any_value("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        .drop("segment", "nth")
    )


def covered(spans):
    """Words in the union of ``spans``."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(
            (
                acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))
            ).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
    )
    return step["n"]


def proximity_matches(
    index: DataFrame,
    items: DataFrame,
    span: int,
    item_id: str = "item_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, start, end``: smallest stretches of at most ``span`` words that hold
    every distinct word of an item, in any order."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    parts = []
    for block in _blocks(items, item_id, text, WINDOW, block_bytes):
        sent = send(spark, block)
        parts.append(
            index.mapInArrow(
                _near_searcher(sent, span),
                f"doc_id {kind}, item_id string, start long, end long",
            )
        )
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _near_searcher(block, span: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = received(block)
        for batch in batches:
            for row in batch.to_pylist():
                postings = _Postings(row)
                starts = np.array(row["starts"])
                ends = starts + np.array(row["lengths"])
                local = items.local(postings)
                out = []
                for number, terms in items.sets:
                    own = [int(local[t]) for t in terms]
                    if min(own) < 0:
                        continue
                    for a, b in postings.near(own, span):
                        d = int(np.searchsorted(starts, a, "right")) - 1
                        if b <= ends[d]:
                            first = int(starts[d])
                            out.append((row["ids"][d], items.names[number], a - first, b - first))
                columns = list(zip(*out)) if out else [[], [], [], []]
                kinds = [
                    batch.schema.field("ids").type.value_type,
                    pa.string(),
                    pa.int64(),
                    pa.int64(),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, kinds)],
                    names=["doc_id", "item_id", "start", "end"],
                )

    return search


# -- uses ----------------------------------------------------------------------------------


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    segment_words: int = SEGMENT_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, spans, contaminated``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "postings")
    build_index(docs, path, doc_id, text, segment_words)
    index = spark.read.parquet(path)
    found = phrase_matches(index, items, window=window, block_bytes=block_bytes)
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        "spans",
    ).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the ids of which any row is contaminated; columns are unchanged."""
    bad = contamination(docs, items, doc_id).where("contaminated").select(
        F.col("doc_id").alias(doc_id)
    )
    return without(docs, bad, doc_id)
