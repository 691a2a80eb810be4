"""Phrase collocations by Toivonen's sampling method, with exact counts.

A sample of the documents proposes phrases: those frequent in it at a lowered threshold. One
pass over all documents then counts exactly the proposed phrases and their negative border, that
is every phrase whose two longest parts (without its last, without its first word) are proposed.
A border phrase that turns out frequent means that longer phrases were missed: it is added, and
a further pass counts what the border gained. Passes end when no border phrase fails, so every
frequent phrase is counted in exactly one pass, over all documents, whatever the sample held.
The sample itself is mined by the same passes, starting from nothing.

Tasks need to know which phrases are proposed. They get a bit filter of fixed size
(``filter_bits``), so what is sent does not grow with the data; a false hit only means that a
phrase is counted without need. Occurrences are combined in tasks, then on the map side.

A phrase is known by 96 bits of two independent hashes until frequent phrases get their words
back: from the sample, and the few others from one more pass.

Defined cases: words and pieces as in ``op12``'s contract, after lower-casing A-Z; a NULL text
has no words; a NULL language is ``und``; repeated rows count as often as they stand; ties are
broken by the phrase's UTF-8 bytes; texts are read in portions, so memory grows with the longest
word, not with the text; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.joins import join_spread
from tracewell.llm.bytehash import Ranges, bytes_of, mixed
from tracewell.llm.filters import FILTER_BITS, Filter
from tracewell.llm.hot import first_rows
from tracewell.llm.shared import cut_lineage, received, send

MAX_WORDS = 4
MIN_COUNT = 30
#: One of so many documents is in the sample.
SAMPLE_OF = 16
_PORTION = 1 << 19
_HELD = 1 << 21  # occurrences combined at once
_SENT = 1 << 16  # rows handed to Spark at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_WORDS_PATTERN = r"[^\x20\x09.,;:!?\x0A-\x0D]+"


# -- words of a batch ----------------------------------------------------------------------


def _reach(data: np.ndarray, end: int, words: int) -> int:
    """Where the ``words``-th word ending after ``end`` ends, or the end of the data."""
    size = 1 << 12
    while end + size < len(data):
        is_word = _CLASS[data[end : end + size]] == _WORD
        ends = np.flatnonzero(is_word[:-1] & ~is_word[1:])
        if len(ends) >= words:
            return end + int(ends[words - 1]) + 2
        size *= 2
    return len(data)


class _Words:
    """Words that start in one portion of a batch, and the few after them."""

    def __init__(self, offsets, data, at: int, languages: np.ndarray) -> None:
        stop = at + _PORTION
        before = min(at, 1)
        part = data[at - before : _reach(data, stop, MAX_WORDS)]
        kind = _CLASS[part]
        is_word = kind == _WORD
        border = np.zeros(len(part) + 1, bool)
        near = offsets[(offsets >= at - before) & (offsets <= at - before + len(part))]
        border[near - (at - before)] = True
        starts = is_word.copy()
        starts[1:] &= ~is_word[:-1] | border[1:-1]
        starts[:before] = False
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:] | border[1:-1]
        if before:
            # A word that began in the portion before ends here; it is not ours.
            ends[:1] = False
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        if before and is_word[:2].all() and not border[1]:
            self.end = self.end[1:]
        self.data = _LOWER[part]
        turn = border[:-1] | (kind == _BREAK)
        self.piece = np.cumsum(turn)[self.start]
        self.owned = int(np.searchsorted(self.start, stop - at + before))
        self.document = np.searchsorted(offsets, self.start + (at - before), "right") - 1
        tongue = languages[self.document]
        self.keys = [
            [mixed(Ranges(self.data, seed).of(self.start, self.end) ^ tongue)] for seed in (1, 2)
        ]
        for k in range(2, MAX_WORDS + 1):
            for keys in self.keys:
                n = max(0, len(self.start) - k + 1)
                keys.append(
                    mixed(keys[-1][:n] * np.uint64(0x9E3779B97F4A7C15) + keys[0][k - 1 :][:n])
                )

    def whole(self, k: int) -> np.ndarray:
        """Which stretches of ``k`` words, from owned words, lie in one piece."""
        n = max(0, len(self.start) - k + 1)
        return (self.piece[:n] == self.piece[k - 1 :][:n]) & (np.arange(n) < self.owned)

    def second(self, k: int) -> np.ndarray:
        """32 more bits of each stretch of ``k`` words; the last two say ``k``."""
        high = (self.keys[1][k - 1] >> np.uint64(32)).astype(np.int64)
        return high & ~np.int64(3) | np.int64(k - 1)

    def text(self, first: int, k: int) -> str:
        """The words of a stretch, one blank between two."""
        ends = zip(self.start[first : first + k], self.end[first : first + k])
        return b" ".join(self.data[s:e].tobytes() for s, e in ends).decode()


def _portions(batch: pa.RecordBatch) -> Iterator[_Words]:
    offsets, data = bytes_of(batch.column("text"))
    tongues = [xxhash.xxh64_intdigest(v.encode()) for v in batch.column("lang").to_pylist()]
    languages = np.array(tongues, np.uint64)
    for at in range(0, len(data), _PORTION):
        yield _Words(offsets, data, at, languages)


# -- passes --------------------------------------------------------------------------------


def _candidates(words: _Words, k: int, now: Filter | None, before: Filter | None) -> np.ndarray:
    """Stretches of ``k`` words to count: both parts are proposed, and were not before."""
    at = np.flatnonzero(words.whole(k))
    if k == 1:
        return at if before is None else at[:0]
    parts = words.keys[0][k - 2]
    if before is not None:
        at = at[now.has(parts[at]) & now.has(parts[at + 1])]
        return at[~(before.has(parts[at]) & before.has(parts[at + 1]))]
    at = at[now.has(parts[at])]
    return at[now.has(parts[at + 1])]


def _combined(a: list, b: list) -> Iterator[pa.RecordBatch]:
    first, second = np.concatenate(a), np.concatenate(b)
    order = np.argsort(first)
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(first)))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(first[at].view(np.int64)), pa.array(second[at]), pa.array(n)],
        names=["a", "b", "n"],
    )
    for i in range(0, len(rows), _SENT):
        yield rows.slice(i, _SENT)


def _counter(now, before) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed = received(now)
        earlier = received(before) if before is not None else None
        a, b, held = [], [], 0
        for batch in batches:
            for words in _portions(batch):
                for k in range(1, MAX_WORDS + 1):
                    at = _candidates(words, k, proposed, earlier)
                    a.append(words.keys[0][k - 1][at])
                    b.append(words.second(k)[at])
                    held += len(at)
                if held >= _HELD:
                    yield from _combined(a, b)
                    a, b, held = [], [], 0
        if held:
            yield from _combined(a, b)

    return run


def _namer(wanted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = received(wanted)
        for batch in batches:
            languages = batch.column("lang")
            for words in _portions(batch):
                for k in range(1, MAX_WORDS + 1):
                    at = np.flatnonzero(words.whole(k))
                    at = at[among.has(words.keys[0][k - 1][at])]
                    a, place = np.unique(words.keys[0][k - 1][at], return_index=True)
                    at = at[place]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(a.view(np.int64)),
                            pa.array(words.second(k)[at]),
                            languages.take(pa.array(words.document[at])),
                            pa.array([words.text(i, k) for i in at.tolist()], pa.string()),
                        ],
                        names=["a", "b", "lang", "phrase"],
                    )

    return run


def _length(b: str = "b"):
    return F.col(b).bitwiseAND(3) + 1


def frequent(
    docs: DataFrame, proposed: DataFrame | None, min_count: int, filter_bits: int, label: str
) -> DataFrame:
    """``a, b, n`` of all phrases found ``min_count`` times or more in ``lang, text``."""
    spark = docs.sparkSession
    now, before = Filter(filter_bits), None
    known = proposed
    if known is not None:
        now = now.with_keys(known.select("a"))
    sent, sent_before, found = send(spark, now), None, []
    while True:
        counted = (
            docs.mapInArrow(_counter(sent, sent_before), "a long, b long, n long")
            .groupBy("a", "b")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count)
        )
        counted = cut_lineage(counted, f"{label}-counted")
        if sent_before is not None:
            sent_before.destroy()  # what needed it is written
        found.append(counted)
        failed = counted if known is None else counted.join(known, ["a", "b"], "left_anti")
        failed = cut_lineage(failed.select("a", "b"), f"{label}-failed")
        # Phrases of the full length have no longer ones that could be missing.
        if failed.where(_length() < MAX_WORDS).isEmpty():
            sent.destroy()
            return reduce(DataFrame.union, found)
        known = failed if known is None else known.union(failed)
        now, before, sent_before = now.with_keys(failed.select("a")), now, sent
        sent = send(spark, now)


def _named(docs: DataFrame, keys: DataFrame, filter_bits: int, label: str) -> DataFrame:
    """``keys`` found in ``docs`` with ``lang`` and ``phrase``."""
    sent = send(docs.sparkSession, Filter(filter_bits).with_keys(keys.select("a")))
    names = docs.mapInArrow(_namer(sent), "a long, b long, lang string, phrase string")
    one = names.groupBy("a", "b").agg(F.min(F.struct("lang", "phrase")).alias("name"))
    named = keys.join(one, ["a", "b"]).select("a", "b", "n", "name.lang", "name.phrase")
    named = cut_lineage(named, f"{label}-named")
    sent.destroy()
    return named


def phrase_counts(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    sample_of: int = SAMPLE_OF,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang, phrase, k, f`` for all phrases of 1 to 4 words found ``min_count`` times.

    ``docs`` has ``lang`` (no NULL) and ``text``; any further column helps to draw the sample.
    """
    drawn = F.pmod(F.xxhash64(*docs.columns), F.lit(sample_of)) == 0
    sample = cut_lineage(docs.where(drawn).select("lang", "text"), "phrases-sample")
    texts = docs.select("lang", "text")
    lowered = max(2, -(-min_count // sample_of))
    proposed = frequent(sample, None, lowered, filter_bits, "phrases-sample")
    proposed = cut_lineage(proposed.select("a", "b"), "phrases-proposed")
    counted = cut_lineage(
        frequent(texts, proposed, min_count, filter_bits, "phrases-all"), "phrases-frequent"
    )
    known = _named(sample, counted, filter_bits, "phrases-sample")
    rest = counted.join(known, ["a", "b"], "left_anti")
    rest = cut_lineage(rest, "phrases-rest")
    found = known.union(_named(texts, rest, filter_bits, "phrases-rest"))
    return found.select("lang", "phrase", _length().cast("int").alias("k"), F.col("n").alias("f"))


# -- scores --------------------------------------------------------------------------------


def _part(first, size):
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    docs: DataFrame,
    doc_id: str = "doc_id",
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    top: int = 2000,
    sample_of: int = SAMPLE_OF,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    own = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).alias("text"),
        F.col(doc_id).alias("doc_id"),
    )
    counts = cut_lineage(phrase_counts(own, min_count, sample_of, filter_bits), "phrases-counts")
    words = F.coalesce(F.regexp_count("text", F.lit(_WORDS_PATTERN)), F.lit(0))
    totals = own.groupBy("lang").agg(F.sum(words.cast("long")).alias("n"))

    split = counts.where("k > 1").withColumn("words", F.split("phrase", " "))
    cuts = split.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        "cut",
        _part(F.lit(1), F.col("cut")).alias("left"),
        _part(F.col("cut") + 1, F.col("k")).alias("right"),
    )
    cuts = cut_lineage(cuts, "phrases-cuts")
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    halves = cut_lineage(join_spread(cuts, left, ["lang", "left"]), "phrases-left")
    both = join_spread(halves, right, ["lang", "right"])
    # Products are taken in decimals of 38 digits, the quotient is rounded down.
    score = F.expr(
        "CAST((CAST(a AS DECIMAL(19, 0)) * CAST(2000000 AS DECIMAL(7, 0)))"
        " DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS LONG)"
    )
    worst = both.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "cut", "a", "l", "r")).alias("best")
    )

    longer = split.where("k > 2").withColumn("size", F.explode(F.expr("sequence(2, k - 1)")))
    longer = longer.withColumn("first", F.explode(F.expr("sequence(1, k - size + 1)")))
    inside = longer.groupBy("lang", _part(F.col("first"), F.col("size")).alias("phrase")).agg(
        F.max("f").alias("most")
    )
    kept = (
        worst.join(inside, ["lang", "phrase"], "left")
        .where("most IS NULL OR 100 * most < 80 * best.a")
        .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    )
    kept = cut_lineage(
        kept.select("*", (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a")), "phrases-kept"
    )
    order = ["_s", "_a", "phrase"]
    chosen = first_rows(kept, ["lang"], order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return (
        chosen.withColumn("rank", rank)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
