"""Repeated windows, collocations and lexical search against row-by-row versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bytehash, hot, lexical, phrases, suffixes
from tracewell.llm.filters import Filter

DOCS = "doc_id long, text string, lang string, core long, doc long, key string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, g, -1, -1, "k") for i, t, g in rows], DOCS)


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- hashes and filters --------------------------------------------------------------------


def test_range_hashes_depend_on_bytes_only():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 5000, dtype=np.uint8)
    hashes = bytehash.Ranges(data, 1)
    starts = rng.integers(0, 4900, 400)
    ends = starts + rng.integers(1, 12, 400)
    found = {}
    for s, e, h in zip(starts, ends, hashes.of(starts, ends)):
        found.setdefault(data[s:e].tobytes(), set()).add(int(h))
    assert all(len(v) == 1 for v in found.values())
    assert len({next(iter(v)) for v in found.values()}) == len(found)
    assert (hashes.every(7) == hashes.of(np.arange(4994), np.arange(4994) + 7)).all()


def test_bytes_of_sliced_and_null_columns():
    column = pa.array(["ab", None, "", "çd"])
    offsets, data = bytehash.bytes_of(column.slice(1))
    assert offsets.tolist() == [0, 0, 0, 3] and data.tobytes() == "çd".encode()


def test_filter_says_yes_to_all_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys], "a long")
    few = Filter(24).with_keys(df)
    assert few.has(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 3000).view(np.uint64)
    assert few.has(others).mean() < 0.01
    full = Filter(8).with_keys(df)  # a full filter admits everything, which is allowed
    assert full.has(others).all()


# -- repeated windows ----------------------------------------------------------------------


def _cut_by_hand(rows, threshold):
    """Removed spans by the definition; rows of one id and text are one document."""
    order = sorted(
        {(i is None, i, hashlib.sha256((t or "").encode()).hexdigest(), t) for i, t in rows},
        key=lambda r: (r[0], r[1] or 0, r[2]),
    )
    seen, out = set(), {}
    for _, doc_id, _, text in order:
        body = (text or "").encode()
        gone = [False] * len(body)
        for s in range(len(body) - threshold + 1):
            window = body[s : s + threshold]
            if window in seen:
                gone[s : s + threshold] = [True] * threshold
            seen.add(window)
        edges = [i for i, (a, b) in enumerate(zip([False, *gone], [*gone, False])) if a != b]
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[(doc_id, text)] = (len(body), list(zip(edges[::2], edges[1::2])), kept)
    return out


def _cut(docs, threshold):
    rows = suffixes.without_repeats(docs, threshold=threshold).collect()
    return [
        (r.doc_id, (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))) for r in rows
    ]


@pytest.mark.parametrize("threshold, portion", [(5, 64), (100, 333)])
def test_repeats_equal_the_definition(spark, monkeypatch, threshold, portion):
    monkeypatch.setattr(suffixes, "_PORTION", portion)
    rng = random.Random(threshold)
    stock = ["".join(rng.choice("abé ") for _ in range(rng.randrange(threshold, 3 * threshold)))
             for _ in range(6)]
    texts = ["".join(rng.choice(stock) + rng.choice(["", "xyz", "\n"]) for _ in range(rng.randrange(5)))
             for _ in range(25)]
    texts += ["a" * (3 * threshold), "a" * (threshold - 1), "ab" * (2 * threshold)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want = _cut_by_hand(list(zip(ids, texts)), threshold)
    got = _cut(_docs(spark, [(i, t, "en") for i, t in zip(ids, texts)]), threshold)
    assert sorted(got) == sorted((i, v) for (i, _), v in want.items())


def test_repeats_edges(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (4, None), (3, ""), (2, "short"), (1, long), (7, long), (7, long), (7, "other " * 40),
        (None, "other " * 40), (None, None),
    ]
    want = _cut_by_hand(rows, 100)
    got = _cut(_docs(spark, [(i, t, None) for i, t in rows]), 100)
    expected = [(i, want[(i, t)]) for i, t in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert suffixes.without_repeats(_docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeated_windows(_docs(spark, []), threshold=1)


# -- collocations --------------------------------------------------------------------------


def _collocations_by_hand(rows, min_count, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}
        ranked = []
        for p, a in found.items():
            longer = [
                b for q, b in found.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, left, right = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                for k in range(1, len(p))
            )
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


@pytest.mark.parametrize("portion, sample_of, bits", [(37, 2, 8), (64, 1000, 20)])
def test_collocations_equal_the_definition(spark, monkeypatch, portion, sample_of, bits):
    """With a sample that proposes nothing, a filter that is full, and cuts inside words."""
    monkeypatch.setattr(phrases, "_PORTION", portion)
    monkeypatch.setattr(phrases, "_HELD", 50)
    rng = random.Random(portion)
    words = ["Der", "der", "ça", "no.", "a-b", "x", "New", "York", "city,", "hall"]
    texts = []
    for _ in range(60):
        text = rng.choice(["New York city hall", "der x", ""])
        for _ in range(rng.randrange(12)):
            text += rng.choice([" ", "\t ", "; ", "\r\n", " "]) + rng.choice(words)
        texts.append((rng.choice(["de", None, "en"]), text))
    docs = _docs(spark, [(i, t, g) for i, (g, t) in enumerate(texts)])
    got = phrases.collocations(docs, min_count=4, top=9, sample_of=sample_of, filter_bits=bits)
    assert {tuple(r) for r in got.collect()} == _collocations_by_hand(texts, 4, 9)


def test_collocations_edges(spark):
    assert phrases.collocations(_docs(spark, [])).count() == 0
    rows = [(i, t, None) for i, t in enumerate([None, "", " . ", "x" * 200_000])]
    rows += [(9, "same two words here", "en")] * 30
    got = {tuple(r)[:4] for r in phrases.collocations(_docs(spark, rows)).collect()}
    assert got == {("en", 1, "same two words here", 30)}


def test_first_rows_of_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), F.col("id").alias("v")
    )
    got = sorted((r.k, r.v) for r in hot.first_rows(rows, ["k"], ["v"], 3).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 10), ("b", 20)]


# -- lexical search ------------------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _search_by_hand(docs, items, top):
    bags = [(i, Counter(_TERM.findall(_lower(t)))) for i, t in docs]
    length = [sum(b.values()) for _, b in bags]
    n, total = sum(v > 0 for v in length), sum(length)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(_TERM.findall(_lower(text)))
        found = []
        for (i, bag), size in zip(bags, length):
            m = 100 - 25 + (25 * size * n) // total if total else 0
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t, times in asked.items()
                if t in bag
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes, portion", [(1 << 22, 1 << 22), (1, 10)])
def test_search_equals_the_definition(spark, monkeypatch, block_bytes, portion):
    monkeypatch.setattr(lexical, "_PORTION", portion)
    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma-ray", "ÜBER", "über", "x2", "_", "the", "the", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(200 + i, texts[5]) for i in range(40)]
    items = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for q in range(8)]
    items_df = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = lexical.search(
        _docs(spark, [(i, t, "en") for i, t in docs]), items_df, top=7, block_bytes=block_bytes
    )
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _search_by_hand(docs, items, 7)


def test_search_edges(spark):
    items = spark.createDataFrame([(1, "one"), (2, None), (3, "!"), (None, "two")], "item_id int, text string")
    empty = lexical.search(_docs(spark, []), items)
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
    docs = [(5, "one two"), (5, "one two"), (None, "two"), (6, None), (7, ""), (8, "other")]
    got = lexical.search(_docs(spark, [(i, t, None) for i, t in docs]), items).collect()
    want = _search_by_hand(docs, [(1, "one"), (None, "two")], 20)
    assert sorted((tuple(r) for r in got), key=repr) == want
    none = spark.createDataFrame([], "item_id int, text string")
    assert lexical.search(_docs(spark, [(1, "a", None)]), none).count() == 0

