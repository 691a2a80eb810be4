"""Ranked lexical search with bag deduplication.

Documents are restricted to the vocabulary of the queries: a document is its *bag*, the counts
of the queries' terms in it, and the length measure ``m``. Documents alike in both score alike
for every query, so they form a class: classes are found by hash and verified by the bag itself,
scored once, and only the classes that reach a result are expanded to members by ascending id.

A class whose smallest id is not among the first ``top`` by score and smallest id holds no
result, since each class before it has a member before all of its own. So ``top`` classes a
query are enough, and of a class its first ``top`` members.

Queries reach the executors in blocks of bounded bytes; each block is one pass over the
documents and the classes. Tasks keep the best classes of each query; sub-keys spread what many
tasks send for one query, and the members of a hot class.

Defined cases: terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased;
NULL and termless texts have no terms, never match and don't count in N; queries without terms
give no rows; query rows alike in id and text count once; every document row is a document, so
repeated rows rank one after the other; ids are ordered as ``hot.numbered`` says (NULL last);
long texts are read in portions; other columns are not looked at; empty tables give empty
results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewell.llm.bytehash import spread
from tracewell.llm.decontam import words_of
from tracewell.llm.hot import first_rows, meet, numbered
from tracewell.llm.shared import cut_lineage, received, send

TOP = 20
#: Queries sent to the executors at once, in bytes of text.
BLOCK_BYTES = 4 << 20
_PORTION = 1 << 22
_CELLS = 1 << 21  # scores held at once
_PAIR = np.dtype([("term", ">u4"), ("tf", ">u4")])


class _Block:
    """Some queries: their ids, vocabulary, and which query asks for a term how often."""

    def __init__(self, rows: list) -> None:
        self.ids = [r[0] for r in rows]
        counts = [Counter(words_of(r[1])) for r in rows]
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        asked = sorted(
            (self.terms[t], q, n) for q, bag in enumerate(counts) for t, n in bag.items()
        )
        term, self.query, self.times = np.array(asked, np.int64).reshape(-1, 3).T
        self.degree = np.bincount(term, minlength=len(self.terms))
        self.first = np.cumsum(self.degree) - self.degree
        self.weight = np.zeros(len(self.terms), np.int64)


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[_Block]:
    """The driver holds one block at a time."""
    rows, held = [], 0
    for row in queries.distinct().toLocalIterator():
        rows.append(row)
        held += len(row[1] or "")
        if held >= block_bytes:
            yield _Block(rows)
            rows, held = [], 0
    yield _Block(rows)


def _portions(text: str) -> Iterator[str]:
    """The text in pieces cut where an ASCII non-term character stands."""
    at = 0
    while len(text) - at > _PORTION:
        cut = text.find(" ", at + _PORTION)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _bags(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = received(sent).terms
        for batch in batches:
            lengths, bags = [], []
            for text in batch.column("text"):
                n, counts = 0, Counter()
                for part in _portions(text.as_py() or ""):
                    words = words_of(part)
                    n += len(words)
                    counts.update(map(terms.get, words))
                counts.pop(None, None)
                lengths.append(n)
                bags.append(np.array(sorted(counts.items()), _PAIR).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(bags, pa.binary()),
                ],
                names=["doc", "doc_id", "n", "bag"],
            )

    return run


class _Best:
    """The best classes of every query seen by a task."""

    def __init__(self, queries: int, top: int) -> None:
        self.top = top
        self.bar = np.ones(queries, np.int64)  # what a score must reach
        self.held = [np.empty(0, np.int64)] * 3  # query, score, smallest id

    def add(self, scores: np.ndarray, first: np.ndarray) -> None:
        row, query = np.nonzero(scores >= self.bar)
        self.held = [
            np.concatenate(pair)
            for pair in zip(self.held, (query, scores[row, query], first[row]))
        ]
        query, score, first = self.held
        order = np.lexsort([first, -score, query])
        begin = np.searchsorted(query[order], np.arange(len(self.bar)))
        nth = np.arange(len(order)) - begin[query[order]]
        self.held = [h[order[nth < self.top]] for h in self.held]
        last = order[nth == self.top - 1]
        self.bar[query[last]] = score[last]


def _scores(block: _Block, counts: np.ndarray, pairs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of all queries for classes with ``counts`` terms each, given by ``pairs``."""
    row = np.repeat(np.arange(len(counts)), counts)
    term, tf = pairs["term"].astype(np.int64), pairs["tf"].astype(np.int64)
    value = block.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    scores = np.zeros((len(counts), len(block.ids)), np.int64)
    asked = spread(block.first[term], block.degree[term])
    again = np.repeat(np.arange(len(term)), block.degree[term])
    np.add.at(scores, (row[again], block.query[asked]), value[again] * block.times[asked])
    return scores


def _ranker(sent, top: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = received(sent)
        best = _Best(len(block.ids), top)
        rows = max(1, _CELLS // max(1, len(block.ids)))
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                bags = part.column("bag").to_pylist()
                counts = np.array([len(b) // _PAIR.itemsize for b in bags])
                pairs = np.frombuffer(b"".join(bags), _PAIR)
                scores = _scores(block, counts, pairs, part.column("m").to_numpy())
                best.add(scores, part.column("first").to_numpy())
        query, score, first = best.held
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query),
                pa.array([block.ids[q] for q in query.tolist()], id_type),
                pa.array(score),
                pa.array(first),
            ],
            names=["query", "item_id", "score", "first"],
        )

    return run


def _ranked(block: _Block, docs: DataFrame, top: int, item_field) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bags = docs.select("doc", "doc_id", "text").mapInArrow(
        _bags(send(spark, block)), f"doc long, doc_id {id_type}, n long, bag binary"
    )
    bags = cut_lineage(bags, "lexical-bags")
    some, every = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    term_of = F.expr("substring(bag, 8 * i + 1, 4)")
    each = bags.where("length(bag) > 0").select(
        "bag", F.explode(F.expr("sequence(0, CAST(length(bag) DIV 8 - 1 AS INT))")).alias("i")
    )
    term = F.conv(F.hex(term_of), 16, 10).cast("int").alias("term")
    for found in each.select(term).groupBy("term").count().toLocalIterator():
        df = found["count"]
        block.weight[found["term"]] = floor(1000 * log((2 * some + 2) / (2 * df + 1)))

    m = (F.lit(100 - 25) + F.expr(f"(25 * n * {some}L) DIV {every or 1}L")).alias("m")
    members = bags.where("length(bag) > 0").select("doc", "doc_id", m, "bag")
    members = members.withColumn("hash", F.xxhash64("m", "bag"))
    classes = members.groupBy("hash", "m", "bag").agg(
        F.min("doc").alias("first"), F.count("*").alias("n")
    )
    classes = cut_lineage(classes, "lexical-classes")

    item_type = item_field.dataType.simpleString()
    reached = classes.select("first", "m", "bag").mapInArrow(
        _ranker(send(spark, block), top, to_arrow_type(item_field.dataType)),
        f"query long, item_id {item_type}, score long, first long",
    )
    reached = reached.withColumn("below", -F.col("score"))
    reached = cut_lineage(first_rows(reached, ["query"], ["below", "first"], top), "lexical-best")
    wanted = classes.join(reached.select("first").distinct(), "first").select(
        "hash", F.col("m").alias("own_m"), F.col("bag").alias("own_bag"), "first", "n"
    )
    wanted = cut_lineage(wanted, "lexical-wanted")
    inside = (
        meet(members, wanted, ["hash"], "n")
        .where("m = own_m AND bag = own_bag")
        .select("first", "doc", "doc_id")
    )
    inside = cut_lineage(first_rows(inside, ["first"], ["doc"], top), "lexical-members")
    rows = reached.join(inside, "first").select(
        "query", "item_id", "doc_id", "score", "below", "doc"
    )
    best = first_rows(rows, ["query"], ["below", "doc"], top)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("below", "doc"))
    return best.select("item_id", rank.alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    query_text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every query."""
    rows = numbered(docs, doc_id, text)
    asked = queries.select(F.col(item_id).alias("item_id"), F.col(query_text).alias("text"))
    parts = [
        _ranked(block, rows, top, asked.schema["item_id"])
        for block in _blocks(asked, block_bytes)
    ]
    return reduce(DataFrame.unionByName, parts)
