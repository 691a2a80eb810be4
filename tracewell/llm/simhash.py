"""Near-duplicate classes by 64-bit SimHash, compared exactly in tiles.

Distinct fingerprints are laid into tiles by the bit counts of their four 16-bit quarters. Two
fingerprints within the radius differ by at most the radius in the summed difference of these
counts, so a tile only meets the tiles whose counts are that close: all other tile pairs are
skipped, and nothing is lost. A tile pair is compared by one numpy exclusive-or and bit count
and hands on a spanning forest of its links; components grow from those by star contraction.

Defined cases: a NULL, empty or blank text has fingerprint zero and is linked like any other;
repeated rows keep one row each; a class whose ids are all NULL has a NULL class id; extra
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import attach, cut_lineage, unused, without

RADIUS = 3
SEED = 42
#: Fingerprints in a tile at most; larger classes of bit counts are split.
TILE = 1 << 16
_QUARTERS = 4
_CELLS = 1 << 22  # compared at once: 32 MB of exclusive-ors


def fingerprint_of(text: str | None) -> int:
    """Unsigned fingerprint over 3-word shingles; repeats count."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    n = max(1, len(words) - 2)
    for a in range(0, n, 1 << 16):
        part = words[a : a + (1 << 16) + 2]
        shingles = zip(part, part[1:], part[2:]) if len(words) > 2 else [words]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > n, bitorder="little")
    return int(packed.view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    found = np.array([fingerprint_of(t) for t in texts], dtype=np.uint64)
    return pd.Series(found.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint (signed bits) as column ``name``."""
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(F.col(text)))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges ``(node, smallest node)`` that join what the links ``u - v`` join."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two tiles of uint64 fingerprints, as pairs of fingerprints."""
    both = np.concatenate([a, b])
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, _CELLS // max(1, len(b)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius
        x, y = np.nonzero(near)
        if len(x):
            nodes, roots = forest(x + i, y + len(a), len(both))
            us.append(nodes)
            vs.append(roots)
    nodes, roots = forest(np.concatenate(us), np.concatenate(vs), len(both))
    return both[nodes], both[roots]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("own"), batch.column("visiting")):
                x = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = b.values.to_numpy(zero_copy_only=False).view(np.uint64)
                out.append(tile_links(x, y, radius))
            left = np.concatenate([o[0] for o in out] or [np.empty(0, np.uint64)])
            right = np.concatenate([o[1] for o in out] or [np.empty(0, np.uint64)])
            differ = left != right
            yield pa.RecordBatch.from_arrays(
                [pa.array(left[differ].view(np.int64)), pa.array(right[differ].view(np.int64))],
                names=["u", "v"],
            )

    return run


def _steps(radius: int) -> list[list[int]]:
    """Differences of the quarters' bit counts within the radius, one of each opposite pair."""
    span = range(-radius, radius + 1)
    found = [
        d
        for d in itertools.product(span, repeat=_QUARTERS)
        if sum(map(abs, d)) <= radius and d >= (0,) * _QUARTERS
    ]
    return [list(d) for d in found]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    counts = F.array(
        *[
            F.bit_count(F.shiftright("fp", 16 * k).bitwiseAND(0xFFFF)).cast("int")
            for k in range(_QUARTERS)
        ]
    )
    signed = prints.select("fp", counts.alias("sig"))
    # At most 17 ** 4 classes of bit counts exist, so this table is small at any size.
    classes = cut_lineage(
        signed.groupBy("sig")
        .agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("subs"))
        .select("sig", "subs"),
        "simhash-classes",
    )
    tiles = (
        signed.join(F.broadcast(classes), "sig")
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
        .groupBy("sig", "sub")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = cut_lineage(tiles, "simhash-tiles")
    steps = F.array(*[F.array(*map(F.lit, d)) for d in _steps(radius)])
    visits = (
        tiles.select("sig", "sub", F.col("fps").alias("visiting"), F.explode(steps).alias("d"))
        .withColumn("target", F.zip_with("sig", "d", lambda s, d: s + d))
        .join(
            F.broadcast(classes.select(F.col("sig").alias("target"), F.col("subs"))), "target"
        )
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .where("target != sig OR to >= sub")
        .select("target", "to", "visiting")
    )
    own = tiles.select(
        F.col("sig").alias("target"), F.col("sub").alias("to"), F.col("fps").alias("own")
    )
    pairs = own.join(visits, ["target", "to"]).select("own", "visiting")
    return pairs.mapInArrow(_compare(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``): alternating star contraction.

    Each round is written and read again. A round costs two grouped minima; hubs are joined
    by inner equi-joins, whose large partitions adaptive execution splits. The sides meet in
    tasks also where they are small: a round would leave five tables broadcast by the driver.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(
            df.agg(
                F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))
            ).first()
        )

    def large(df: DataFrame) -> DataFrame:
        both = df.union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.where("v > u").join(least.hint("merge"), "u")
        return met.select(F.col("v").alias("u"), "m")

    def small(df: DataFrame) -> DataFrame:
        down = df.select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        # The link to the least one is that of the node itself.
        own = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u")
        return down.join(least.hint("merge"), "u").select(own, "m")

    now = edges.where("u != v").select("u", "v").distinct()
    now = cut_lineage(now, "simhash-links")
    seen = state(now)
    while seen[0]:
        step = small(large(now).where("u != m")).where("u != m")
        now = cut_lineage(
            step.select("u", F.col("m").alias("v")).distinct(), "simhash-stars"
        )
        new = state(now)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v").distinct())


def classes(
    docs: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS
) -> DataFrame:
    """``fp, root, component_id, n`` for every distinct fingerprint of ``docs``."""
    prints = cut_lineage(
        docs.groupBy(F.col(fp).alias("fp")).agg(
            F.min(doc_id).alias("first"), F.count("*").alias("n")
        ),
        "simhash-prints",
    )
    roots = components(links(prints, radius)).withColumnRenamed("node", "fp")
    placed = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(firsts, "root").select("fp", "root", "component_id", "n")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    printed = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), text), text)
    printed = cut_lineage(printed.select("doc_id", "fp"), "simhash-docs")
    groups = cut_lineage(classes(printed, radius=radius), "simhash-groups")
    return attach(printed, groups, "fp", "n", "component_id").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row left of every class: that of the smallest id.

    Of repeated rows with the smallest id one stays. Other columns pass through unchanged.
    """
    row, fp = unused(docs, "_row"), unused(docs, "_fp")
    marked = fingerprints(docs, text, fp).withColumn(row, F.monotonically_increasing_id())
    marked = cut_lineage(marked, "simhash-marked")
    narrow = marked.select(
        F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row")
    )
    groups = cut_lineage(classes(narrow), "simhash-groups")
    placed = cut_lineage(attach(narrow, groups, "fp", "n", "root"), "simhash-placed")
    best = placed.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))["row"].alias("row")
    )
    gone = placed.select("row").join(best, "row", "left_anti")
    return without(marked, gone.withColumnRenamed("row", row), row).select(*docs.columns)
