"""Quality by perplexity under an interpolated modified Kneser-Ney character model.

For every language a model of character n-grams inside words is trained on all trusted text:
tasks count n-grams of their documents, the counts are sharded by n-gram and summed, and joins
of the sharded counts with their contexts and shorter n-grams give discounted probabilities
and back-off weights. Documents are dealt into folds by their ids, and a fold is scored by the
model of the trusted documents of the other folds, so no document is scored by a model that
has read it. Each document's perplexity per character is compared with a quantile of the
perplexities of its language's trusted documents, which are held out like all others. A second
model also reads the rejected documents of the other folds; what it gains over the first is a
contrast that single insults in fluent text raise, while they hardly move the perplexity.

A document needs the models of its language and fold only. Tasks put the tables of each language
and fold together and write them compressed; scoring sends them to the tasks in as many rounds as
the bound of a broadcast asks for, one round after the other, so the driver never holds the bytes
of more than one. A fold that would pass the bound alone is scored by joins. Ids of trusted and
rejected documents that pass it are broadcast in portions, one after the other, so the text of
documents is never shuffled to be counted.

Defined cases: a document without words, or in a language without trusted text in the other
folds, has no perplexity and is kept, not suspect; so is one whose language has no held-out
perplexity of a trusted document; a NULL language is a language of its own; a document counts as trusted
once per row of its id in the trusted table at most; repeated documents are trained on and
scored like others; columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.cluster import scratch_path
from tracewell.llm.bytehash import bytes_of
from tracewell.llm.shared import BROADCAST_BYTES, cut_lineage, received, send

ORDER = 5
#: Documents above this quantile of their language's trusted perplexities are rejected.
QUANTILE = 0.999
#: This share of a language's trusted documents is not suspect, by perplexity and contrast together.
SUSPECT_QUANTILE = 0.98
#: Documents are scored by models of the other folds; text is counted once, whatever their number.
FOLDS = 4
#: Perplexities are compared by their logarithm in steps of this size.
STEP = 1e-4
START, END = "\x02", "\x03"
#: Distinct words a task holds while it counts, and cuts into n-grams at once.
_FLUSH = 1 << 18
_AT_ONCE = 1 << 15
#: What a row of a model weighs compressed: its key, and its values for each model.
_KEY_BYTES = 2
_VALUES_BYTES = 8
#: Models reach the driver in pieces of so many bytes, from so many tasks: the JVM makes room for
#: large arrays by growing its heap, however soon they are let go.
_PIECE = 1 << 18
_PIECES_AT_ONCE = 16
_PIECE_TASKS = 32


def padded(word: str, order: int) -> str:
    """A word with the marks that its n-grams need."""
    return START * (order - 1) + word + END


def distinct_grams(words: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of ``words``, the one before each predicted character, and sizes.

    An n-gram is a row of ``order`` characters, of which the last is predicted. Characters run
    on from word to word; ``sizes`` has how many are predicted in each. No word may be missing.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    text = "".join([padded(w, order) for w in words])
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = np.arange(sizes.sum()) + np.repeat(np.arange(len(words)) * (order - 1), sizes)
    used = np.zeros(int(chars.max()) + 1, np.int64)
    used[chars] = 1
    letters = int(used.sum())
    codes = (np.cumsum(used) - 1)[chars]
    numbers, span = codes[starts], letters
    for i in range(1, order):
        if span * letters >= 1 << 62:
            # Too many letters for one number: go on from the place among what occurs.
            numbers = np.unique(numbers, return_inverse=True)[1]
            span = int(numbers.max()) + 1
        numbers = numbers * letters + codes[starts + i]
        span *= letters
    different, which = np.unique(numbers, return_inverse=True)
    begins = np.empty(len(different), np.int64)
    begins[which] = starts  # any of its places will do
    return chars[begins[:, None] + np.arange(order)], which, sizes


# -- counting ------------------------------------------------------------------------------


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in words.items():
                grams: dict[str, int] = defaultdict(int)
                found = list(own)
                times = np.fromiter(own.values(), np.int64, len(own))
                for i in range(0, len(found), _AT_ONCE):
                    chars, which, sizes = distinct_grams(found[i : i + _AT_ONCE], order)
                    sums = np.zeros(len(chars), np.int64)
                    np.add.at(sums, which, np.repeat(times[i : i + _AT_ONCE], sizes))
                    text = chars.tobytes().decode("utf-32-le")
                    for k, n in enumerate(sums.tolist()):
                        grams[text[k * order : (k + 1) * order]] += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array(list(grams), pa.string()),
                        pa.array(list(grams.values()), pa.int64()),
                    ],
                    names=["lang", "g", "raw"],
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = (text.as_py() or "").split()
                own = words.setdefault(lang, Counter())
                before = len(own)
                own.update(found)
                held += len(own) - before
                if held > _FLUSH:
                    yield from flush()
                    words, held = {}, 0
        yield from flush()

    return run


def _gram_parts(docs: DataFrame, order: int) -> DataFrame:
    """``lang, g, raw`` with a row per task at least; sums are left to the caller."""
    return docs.select("lang", "text").mapInArrow(_count(order), "lang string, g string, raw long")


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, g, raw``: how often each n-gram of the highest order occurs in ``docs``."""
    return _gram_parts(docs, order).groupBy("lang", "g").agg(F.sum("raw").alias("raw"))


def train(counts: DataFrame, order: int = ORDER, models: Sequence[str] = ("",)) -> DataFrame:
    """``lang, k, g, logp, backoff`` of all n-grams of order ``k = 0 .. order``.

    ``logp`` is the interpolated log-probability of the last character of ``g`` after the
    others; ``backoff`` the log-weight that the shorter context gets after ``g``, where ``g``
    was seen as a context. Order 0 is the uniform distribution over seen characters and one.
    All ``models`` are trained by the same joins: model ``m`` reads its counts from ``raw<m>``,
    and its values, NULL for what it has not seen, are ``logp<m>`` and ``backoff<m>``.
    """

    def each(build):
        return [build(m) for m in models]

    level = counts.select("lang", "g", *each(lambda m: F.col(f"raw{m}"))).select(
        "*", *each(lambda m: F.col(f"raw{m}").alias(f"adj{m}"))
    )
    levels = {order: level}
    for k in range(order - 1, 0, -1):
        # A gram's adjusted count is the number of different characters before it; one that
        # begins at the start of a word has no other context and keeps its raw count.
        shorter = (
            level.withColumn("g", F.substring("g", 2, k))
            .groupBy("lang", "g")
            .agg(
                *each(lambda m: F.sum(f"raw{m}").alias(f"raw{m}")),
                *each(lambda m: F.sum((F.col(f"raw{m}") > 0).cast("long")).alias(f"types{m}")),
            )
        )
        first = F.col("g").startswith(START)

        def adjusted(m):
            return F.when(first, F.col(f"raw{m}")).otherwise(F.col(f"types{m}")).alias(f"adj{m}")

        level = shorter.select("lang", "g", *each(lambda m: F.col(f"raw{m}")), *each(adjusted))
        level = cut_lineage(level, f"kn-counts-{k}")
        levels[k] = level

    def uniform_of(m):
        # A model that has read nothing has no distribution at all.
        seen = F.sum((F.col(f"adj{m}") > 0).cast("long"))
        return F.when(seen > 0, -F.log(seen + 1.0)).alias(f"logp{m}")

    below = (
        levels[1].groupBy("lang").agg(*each(uniform_of)).withColumn("g", F.lit(""))
    )
    logps = [f"logp{m}" for m in models]
    known = [below.select("lang", F.lit(0).alias("k"), "g", *logps)]
    every = None
    for k, grams in levels.items():
        own = grams.select("lang", F.lit(k).alias("k"), "g", *each(lambda m: F.col(f"adj{m}")))
        every = own if every is None else every.unionByName(own)
    kinds = every.groupBy("lang", "k").agg(
        *[
            F.sum((F.col(f"adj{m}") == i).cast("double")).alias(f"n{i}{m}")
            for i in (1, 2, 3, 4)
            for m in models
        ]
    )

    def discount(i: int, m: str):
        # Closed form; with too few counts of counts, half of the count's rank.
        n1, now, more = F.col(f"n1{m}"), F.col(f"n{i}{m}"), F.col(f"n{i + 1}{m}")
        exact = i - (i + 1) * (n1 / (n1 + 2 * F.col(f"n2{m}"))) * more / now
        usable = (now > 0) & (more > 0) & (n1 > 0)
        return F.greatest(
            F.lit(0.05), F.least(F.lit(i - 0.05), F.when(usable, exact).otherwise(i * 0.5))
        ).alias(f"d{i}{m}")

    # A row per language and order.
    rates = cut_lineage(
        kinds.select(
            F.col("lang").alias("lang1"),
            F.col("k").alias("k1"),
            *[discount(i, m) for i in (1, 2, 3) for m in models],
        ),
        "kn-rates",
    )

    def cut(m: str):
        adj = F.col(f"adj{m}")
        rate = F.when(adj == 1, F.col(f"d1{m}")).when(adj == 2, F.col(f"d2{m}"))
        return F.when(adj > 0, rate.otherwise(F.col(f"d3{m}"))).otherwise(0.0).alias(f"d{m}")

    # A context has a row per character after it at most.
    context = Window.partitionBy("lang", "k", "h")

    def total(m: str):
        return F.sum(f"adj{m}").over(context).alias(f"total{m}")

    def freed(m: str):
        return F.sum(f"d{m}").over(context).alias(f"freed{m}")

    def share(m: str):
        kept = (F.col(f"adj{m}") - F.col(f"d{m}")) / F.col(f"total{m}")
        return F.when(F.col(f"adj{m}") > 0, kept).alias(f"share{m}")

    def free(m: str):
        return F.when(F.col(f"total{m}") > 0, F.col(f"freed{m}") / F.col(f"total{m}")).alias(
            f"free{m}"
        )

    # All orders at once: fewer jobs, each of which costs the driver a plan and its broadcasts.
    same = F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("k") == F.col("k1"))
    shares = cut_lineage(
        every.join(F.broadcast(rates), same)
        .select(
            "lang",
            "k",
            "g",
            F.expr("left(g, length(g) - 1)").alias("h"),
            *each(lambda m: F.col(f"adj{m}")),
            *each(cut),
        )
        .select("*", *each(total), *each(freed))
        .select("lang", "k", "g", "h", *each(share), *each(free)),
        "kn-shares",
    )
    for k in range(1, order + 1):
        shorter = below.select(
            F.col("lang").alias("lang2"),
            F.col("g").alias("g2"),
            *each(lambda m: F.col(f"logp{m}").alias(f"low{m}")),
        )

        def logp(m: str):
            value = F.col(f"share{m}") + F.col(f"free{m}") * F.exp(f"low{m}")
            return F.log(value).alias(f"logp{m}")

        # Both sides grow with the vocabulary: they meet in tasks and are never sent to the driver.
        scored = (
            shares.where(F.col("k") == k)
            .withColumn("s", F.substring("g", 2, k))
            .join(
                shorter.hint("merge"),
                F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("s") == F.col("g2")),
            )
            .select("lang", "k", "g", *each(logp))
        )
        below = cut_lineage(scored, f"kn-order-{k}")
        known.append(below)

    def weight(m: str):
        return F.log(F.first(f"free{m}")).alias(f"backoff{m}")

    backoffs = shares.groupBy(
        F.col("lang").alias("lang4"), (F.col("k") - 1).alias("k4"), F.col("h").alias("g4")
    ).agg(*each(weight))
    grams = known[0]
    for more in known[1:]:
        grams = grams.unionByName(more)
    # Contexts at the start of a word were never predicted and have a weight only.
    both = grams.join(
        backoffs,
        F.col("lang").eqNullSafe(F.col("lang4"))
        & (F.col("k") == F.col("k4"))
        & (F.col("g") == F.col("g4")),
        "full",
    )
    return both.select(
        F.when(F.col("g").isNull(), F.col("lang4")).otherwise(F.col("lang")).alias("lang"),
        F.coalesce("k", "k4").alias("k"),
        F.coalesce("g", "g4").alias("g"),
        *logps,
        *each(lambda m: F.col(f"backoff{m}")),
    )


# -- scoring -------------------------------------------------------------------------------


class Model:
    """Sorted tables of one language; an n-gram's number is its place in its order's table.

    The key of a gram is the number of the gram after its first character, and that character,
    so no hashing and no alphabet limit is involved: where a gram was seen, so was what it ends
    with. The tables hold the values of all ``names``; what one of these models has not seen is
    NaN there, and so is the last place, which the number -1 of unknown grams stands for.
    """

    def __init__(self, rows: pd.DataFrame, order: int, names: Sequence[str] = ("",)) -> None:
        self.order = order
        base = rows[rows.k == 0].iloc[0]
        self.uniform = {m: base[f"logp{m}"] for m in names}
        self.free = {m: base[f"backoff{m}"] for m in names}
        self.keys: list[np.ndarray] = []
        self.logp: list[dict[str, np.ndarray]] = []
        #: Of the contexts, which are shorter than the longest grams.
        self.backoff: list[dict[str, np.ndarray]] = []
        for k in range(1, order + 1):
            chosen = np.flatnonzero(rows.k == k)
            grams = pa.array(rows.g.iloc[chosen], pa.string())
            if isinstance(grams, pa.ChunkedArray):
                grams = grams.combine_chunks()
            text = bytes_of(grams)[1].tobytes().decode()
            chars = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(-1, k).T
            rest = np.zeros(len(chosen), np.int64)
            for i in range(1, k):
                rest = self._longer(i, rest, chars[k - i])
            keys = (rest << 21) | chars[0]
            by = np.argsort(keys)
            self.keys.append(keys[by])

            def values(name: str, places: np.ndarray = chosen[by]) -> np.ndarray:
                return np.append(rows[name].to_numpy(np.float64)[places], np.nan)

            self.logp.append({m: values(f"logp{m}") for m in names})
            if k < order:
                self.backoff.append({m: values(f"backoff{m}") for m in names})

    def _longer(self, k: int, rest: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of grams of order ``k``, by the number of what follows the first character."""
        keys, wanted = self.keys[k - 1], (rest << 21) | first
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def score(self, words: list[str], names: Sequence[str] = ("",)) -> tuple[list, np.ndarray]:
        """Log-probabilities of each word, an array per name, and its predicted characters.

        What a character costs depends on its n-gram alone, so each n-gram is looked up once.
        """
        if not words:
            return [np.empty(0) for _ in names], np.empty(0, np.int64)
        grams, which, sizes = distinct_grams(words, self.order)
        chars = np.ascontiguousarray(grams.T).astype(np.int64)
        totals = [np.full(len(grams), self.uniform[m]) for m in names]
        # The numbers of the k characters up to the predicted one, and of those before it.
        gram = context = np.zeros(len(grams), np.int64)
        for k in range(1, self.order + 1):
            gram = self._longer(k, gram, chars[self.order - k])
            for i, m in enumerate(names):
                weight = (
                    np.full(len(grams), self.free[m]) if k == 1 else self.backoff[k - 2][m][context]
                )
                own = self.logp[k - 1][m][gram]
                lower = totals[i] + np.nan_to_num(weight, nan=0.0)
                totals[i] = np.where(np.isnan(own), lower, own)
            if k < self.order:
                context = self._longer(k, context, chars[self.order - 1 - k])
        begins = np.cumsum(sizes) - sizes
        return [np.add.reduceat(total[which], begins) for total in totals], sizes


def _packer(order: int, names: Sequence[str]):
    """``lang, piece, model``: the tables of a language as compressed bytes, cut into pieces."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        whole = cloudpickle.dumps(Model(rows, order, names))
        # Each task that scores unpacks it again, which zstd does three times as fast as zlib.
        packed = len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)
        cut = [packed[i : i + _PIECE] for i in range(0, len(packed), _PIECE)]
        return pd.DataFrame(
            {"lang": [rows.lang.iloc[0]] * len(cut), "piece": range(len(cut)), "model": cut}
        )

    return run


def _lean_packer(order: int, names: Sequence[str]):
    """``_packer`` of Arrow tables: no Python object per n-gram is made."""
    run = _packer(order, names)

    def packed(rows: pa.Table) -> pa.Table:
        frame = rows.to_pandas(types_mapper={pa.string(): pd.ArrowDtype(pa.string())}.get)
        schema = [("lang", pa.string()), ("piece", pa.int64()), ("model", pa.binary())]
        built = run(frame)
        built["lang"] = [rows.column("lang")[0].as_py()] * len(built)
        return pa.Table.from_pandas(built, pa.schema(schema), preserve_index=False)

    return packed


def _unpacked(packed: bytes) -> Model:
    size = int.from_bytes(packed[:8], "little")
    return cloudpickle.loads(pa.decompress(packed[8:], size, codec="zstd", asbytes=True))


def _scorer(sent: Sequence[Broadcast], names: Sequence[Sequence[str]]):
    """``chars`` of each text, and its loss under each model of its fold: ``nll``, ``nll1``..."""
    held: list[dict] = []
    opened: dict[Unit, Model] = {}
    losses = _losses(names)

    @F.pandas_udf(", ".join(f"{n} double" for n in losses) + ", chars long")
    def run(langs: pd.Series, folds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append({})
            for some in sent:
                for unit, pieces in received(some).items():
                    held[0].setdefault(unit, []).extend(pieces)
        packed = held[0]
        nll, chars = np.full((len(losses), len(texts)), np.nan), np.zeros(len(texts), np.int64)
        rows: dict[tuple[str | None, int], list[int]] = {}
        for i, key in enumerate(zip(langs, folds)):
            rows.setdefault(key, []).append(i)
        for (lang, fold), own in rows.items():
            unit = (lang, int(fold))
            if unit not in packed:
                continue
            if unit not in opened:
                opened[unit] = _unpacked(b"".join(packed[unit]))
            number: dict[str, int] = defaultdict(count().__next__)
            waiting: list[tuple[int, np.ndarray]] = []
            for i in own:
                words = (texts.iat[i] or "").split()
                used = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                waiting.append((i, used))
                if len(number) >= _AT_ONCE or i == own[-1]:
                    logs, sizes = opened[unit].score(list(number), names[fold])
                    for k, used in waiting:
                        if len(used):
                            nll[:, k] = [-own_logs[used].sum() for own_logs in logs]
                            chars[k] = sizes[used].sum()
                    number, waiting = defaultdict(count().__next__), []
        # A model that has read nothing gives no loss, and so no verdict.
        chars[np.isnan(nll[0])] = 0
        return pd.DataFrame({**dict(zip(losses, nll)), "chars": chars})

    return run


def _losses(names: Sequence[Sequence[str]]) -> list[str]:
    return [f"nll{i or ''}" for i in range(len(names[0]))]


#: A language and one of its folds.
Unit = tuple[str | None, int]


def _values(names: Sequence[str]) -> list[str]:
    return [f"{what}{m}" for m in names for what in ("logp", "backoff")]


def _units(
    model: DataFrame, names: Sequence[Sequence[str]], bound: int
) -> tuple[list[Unit], list[Unit]]:
    """The folds of each language that fit the bound, and those too large for it alone."""

    def rows(own: Sequence[str]) -> Column:
        return F.count(F.coalesce(*_values(own)))

    fit: list[Unit] = []
    large: list[Unit] = []
    found = model.groupBy("lang").agg(*[rows(own).alias(f"n{f}") for f, own in enumerate(names)])
    for r in sorted(found.collect(), key=lambda r: r["lang"] or ""):
        for f, own in enumerate(names):
            size = (1 + r[f"n{f}"]) * (_KEY_BYTES + _VALUES_BYTES * len(own))
            (fit if size <= bound else large).append((r["lang"], f))
    return fit, large


def _of_langs(df: DataFrame, langs: list[str | None]):
    # NULL is asked for by itself: it is in no list, and not NULL in an empty one.
    named = F.coalesce(F.col("lang").isin([x for x in langs if x is not None]), F.lit(False))
    return named | F.col("lang").isNull() if None in langs else named


def _of_units(df: DataFrame, units: list[Unit], fold: Column):
    """Rows of these languages and folds."""
    chosen = F.lit(False)
    for f in sorted({f for _, f in units}):
        chosen |= (fold == f) & _of_langs(df, [lang for lang, g in units if g == f])
    return chosen


def _packed(
    model: DataFrame, units: list[Unit], order: int, names: Sequence[Sequence[str]]
) -> DataFrame:
    """``fold, lang, piece, model``: the compressed tables of each unit, put together by a task."""
    packed = None
    for f in sorted({f for _, f in units}):
        seen = F.coalesce(*_values(names[f])).isNotNull()
        rows = (
            model.where(_of_langs(model, [lang for lang, g in units if g == f]))
            .where(seen | (F.col("k") == 0))
            .select("lang", "k", "g", *_values(names[f]))
        )
        built = rows.groupBy("lang").applyInArrow(
            _lean_packer(order, names[f]), "lang string, piece long, model binary"
        )
        built = built.select(F.lit(f).alias("fold"), "*")
        packed = built if packed is None else packed.unionByName(built)
    return cut_lineage(packed, "kn-packed")


def _rounds(packed: DataFrame, bound: int) -> list[list[Unit]]:
    """Units that are sent together: a quarter of the bound, measured, or one alone."""
    sizes = packed.groupBy("lang", "fold").agg(F.sum(F.length("model")).alias("size")).collect()
    rounds: list[list[Unit]] = []
    room = 0
    for size, lang, f in sorted(
        ((r["size"], r["lang"], r["fold"]) for r in sizes), key=lambda x: (x[0], x[1] or "", x[2])
    ):
        if not rounds or size > room:
            rounds.append([])
            room = bound // 4
        rounds[-1].append((lang, f))
        room -= size
    return rounds


def _sent(packed: DataFrame, units: list[Unit]) -> list[Broadcast]:
    """The tables of ``units``, which the driver only passes on, so many pieces of each at once."""
    own = packed.where(_of_units(packed, units, F.col("fold")))
    sent = []
    for first in range(0, 1 + own.agg(F.max("piece")).first()[0], _PIECES_AT_ONCE):
        some = own.where((F.col("piece") >= first) & (F.col("piece") < first + _PIECES_AT_ONCE))
        found: dict[Unit, list[bytes]] = {}
        rows = some.repartition(_PIECE_TASKS, "lang", "piece").collect()
        for r in sorted(rows, key=lambda r: r["piece"]):
            found.setdefault((r["lang"], r["fold"]), []).append(r["model"])
        sent.append(send(packed.sparkSession, found))
    return sent


def _by_joins(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The same scores by shuffled joins, for models beyond the broadcast bound.

    Distinct words are cut into n-grams and joined with the model by n-gram; word scores are
    joined with each document's word counts.
    """
    tagged = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()), "kn-rows")
    blanks = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _BLANKS) + "]+"
    used = (
        tagged.select("_row", "lang", F.explode(F.split("text", blanks)).alias("w"))
        .where("w != ''")
        .groupBy("_row", "lang", "w")
        .agg(F.count("*").alias("n"))
    )
    used = cut_lineage(used, "kn-used")
    marked = F.concat(F.lit(START * (order - 1)), F.col("w"), F.lit(END))
    spots = used.select("lang", "w").distinct().select(
        "lang", "w", marked.alias("p"), F.explode(F.sequence(F.lit(1), F.length("w") + 1)).alias("i")
    )
    cut = spots.select("*", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"))
    end = F.col("i") + order - 1
    cut = cut.select(
        "lang",
        "w",
        "i",
        "k",
        F.substring(F.col("p"), end - F.col("k") + 1, F.col("k")).alias("g"),
        F.when(F.col("k") > 0, F.substring(F.col("p"), end - F.col("k") + 1, F.col("k") - 1)).alias("h"),
    )
    grams = model.select(
        F.col("lang").alias("l1"), F.col("k").alias("k1"), F.col("g").alias("g1"), "logp"
    )
    weights = model.select(
        F.col("lang").alias("l2"), F.col("k").alias("k2"), F.col("g").alias("g2"), "backoff"
    )
    met = cut.join(
        grams,
        F.col("lang").eqNullSafe(F.col("l1")) & (F.col("k") == F.col("k1")) & (F.col("g") == F.col("g1")),
        "left",
    ).join(
        weights,
        F.col("lang").eqNullSafe(F.col("l2"))
        & (F.col("k") - 1 == F.col("k2"))
        & (F.col("h") == F.col("g2")),
        "left",
    )
    steps = F.sort_array(F.collect_list(F.struct("k", "logp", "backoff")))
    value = F.aggregate(
        steps,
        F.lit(0.0),
        lambda acc, x: F.coalesce(x["logp"], acc + F.coalesce(x["backoff"], F.lit(0.0))),
    )
    words = (
        met.groupBy("lang", "w", "i")
        .agg(value.alias("v"))
        .groupBy("lang", "w")
        .agg((-F.sum("v")).alias("nll"), F.count("*").alias("chars"))
        .withColumnsRenamed({"lang": "l3", "w": "w3"})
    )
    sums = (
        used.join(words, F.col("lang").eqNullSafe(F.col("l3")) & (F.col("w") == F.col("w3")))
        .groupBy("_row")
        .agg(F.sum(F.col("n") * F.col("nll")).alias("nll"), F.sum(F.col("n") * F.col("chars")).alias("chars"))
    )
    return tagged.join(sums, "_row", "left").select(
        *docs.columns, F.struct("nll", F.coalesce("chars", F.lit(0)).alias("chars")).alias("_s")
    )


#: What ``str.split`` takes for blanks.
_BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def scored(
    docs: DataFrame,
    model: DataFrame,
    order: int = ORDER,
    bound: int = BROADCAST_BYTES,
    names: Sequence[Sequence[str]] = (("",),),
    fold: Column | None = None,
) -> DataFrame:
    """``docs`` with ``_s``: the negative log-likelihood ``nll`` and characters ``chars``.

    A document of ``fold`` f is scored at once by all models ``names[f]`` of its language, the
    later ones as ``nll1``, ``nll2`` and so on.
    """
    fold = F.lit(0) if fold is None else fold
    parts = [part for part, _ in _scored_parts(docs, model, order, bound, names, fold)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _scored_parts(
    docs: DataFrame,
    model: DataFrame,
    order: int,
    bound: int,
    names: Sequence[Sequence[str]],
    fold: Column,
) -> Iterator[tuple[DataFrame, Sequence[Broadcast]]]:
    """The rows of ``scored`` in parts, each with the models sent for it.

    A round's models are put together when its part is asked for. Who writes a part and destroys
    its models before the next one has one round of them in the driver, whatever their number.
    """
    fit, large = _units(model, names, bound)
    losses = _losses(names)
    known = list({lang for lang, _ in [*fit, *large]})
    rest = docs.where(~_of_langs(docs, known))
    empty = ", ".join(f"{n}: double" for n in losses)
    yield rest.withColumn("_s", F.lit(None).cast(f"struct<{empty}, chars: bigint>")), ()
    if fit:
        # A task per language and fold, each within the bound; the driver only passes their bytes on.
        packed = _packed(model, fit, order, names)
        for units in _rounds(packed, bound):
            sent = _sent(packed, units)
            run = _scorer(sent, names)
            own = docs.where(_of_units(docs, units, fold))
            yield own.withColumn("_s", run("lang", fold.cast("int"), "text")), sent
    for lang, f in large:
        own, done = docs.where(_of_langs(docs, [lang]) & (fold == f)), []
        grams = model.where(_of_langs(model, [lang]))
        for i, m in enumerate(names[f]):
            seen = grams.select(
                "lang", "k", "g", F.col(f"logp{m}").alias("logp"), F.col(f"backoff{m}").alias("backoff")
            )
            own = _by_joins(own, seen.where("logp IS NOT NULL OR backoff IS NOT NULL"), order)
            own = own.withColumnRenamed("_s", f"_s{i}")
            done.append(F.col(f"_s{i}.nll").alias(losses[i]))
        own = own.withColumn("_s", F.struct(*done, F.col("_s0.chars").alias("chars")))
        yield own.select(*docs.columns, "_s"), ()


#: Models of the trusted text alone, and of trusted and rejected text together.
GOOD, BOTH = "g", "b"


def held_out(parts: DataFrame, folds: int, kinds: Sequence[str]) -> DataFrame:
    """``lang, g`` and for the model of each kind and fold the count in the other folds.

    ``lang`` of ``parts`` is the mark of trusted (``GOOD``) or rejected text, the fold in one
    digit (ten folds at most), and ``=`` and the language unless that is NULL. Trusted text is read by the models of
    all kinds, rejected text by ``BOTH``.
    """
    split = parts.select(
        F.substring("lang", 1, 1).alias("_of"),
        F.substring("lang", 2, 1).cast("int").alias("_fold"),
        F.when(F.length("lang") > 2, F.expr("substring(lang, 4)")).alias("lang"),
        "g",
        "raw",
    )

    def count(kind: str, f: int):
        read = (F.col("_fold") != f) & (F.lit(kind == BOTH) | (F.col("_of") == GOOD))
        return F.sum(F.when(read, F.col("raw")).otherwise(0)).alias(f"raw_{kind}{f}")

    return split.groupBy("lang", "g").agg(*[count(k, f) for k in kinds for f in range(folds)])


def _counted(
    docs: DataFrame, taught: DataFrame, order: int, folds: int, kinds: Sequence[str]
) -> DataFrame:
    """``held_out`` counts of the documents whose ``_key`` is taught, whatever the number of ids.

    Ids are broadcast in portions, and what is counted for one is written before the next, so
    neither are the texts of documents shuffled nor does the driver hold more than a portion.
    """
    tag = F.concat("_kind", F.col("_fold").cast("string"))
    tag = F.concat(tag, F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")))

    def of(ids: DataFrame) -> DataFrame:
        read = docs.join(F.broadcast(ids), F.col("_key") == F.col("_id"))
        return held_out(_gram_parts(read.withColumn("lang", tag), order), folds, kinds)

    portions = max(1, -(-_ids_bytes(taught) // BROADCAST_BYTES))
    if portions == 1:
        return cut_lineage(of(taught), "kn-counts")
    dealt = F.pmod(F.xxhash64("_id"), F.lit(portions))
    some = _written(((of(taught.where(dealt == i)), ()) for i in range(portions)), "kn-portions")
    sums = [F.sum(c).alias(c) for c in some.columns if c not in ("lang", "g")]
    return cut_lineage(some.groupBy("lang", "g").agg(*sums), "kn-counts")


_RESULTS = ("trusted", "n_scored", "log_perplexity", "threshold", "kept", "suspect")


def judged(
    docs: DataFrame,
    trusted: DataFrame,
    doc_id: str = "doc_id",
    order: int = ORDER,
    quantile: float = QUANTILE,
    suspect_quantile: float = SUSPECT_QUANTILE,
    keep_text: bool = True,
    folds: int = FOLDS,
    rejected: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``trusted, n_scored, log_perplexity, threshold, kept, suspect``.

    ``kept`` goes by ``quantile`` of the perplexities alone. ``suspect`` goes by the stricter
    ``suspect_quantile``, and with ids of ``rejected`` documents also by a contrast: how much
    likelier, per character, a document gets when its model reads the rejected text as well.
    Both are held against the trusted documents. ``suspect`` is the verdict to act on.

    ``docs`` needs ``doc_id``, ``lang`` and ``text``; ``trusted`` holds the ids of the trusted
    documents in its column ``doc_id``. Without ``keep_text`` the text is left out. Columns of
    ``docs`` named like a result are replaced, all others pass through whatever their names.
    """
    passed = [c for c in docs.columns if c not in _RESULTS and (keep_text or c != "text")]
    rows, places, taught = _judged(
        docs, passed, trusted, doc_id, order, quantile, suspect_quantile, folds, rejected
    )
    rows = rows.join(_if_small(taught), F.col("_key") == F.col("_id"), "left").withColumn(
        "trusted", F.coalesce(F.col("_kind") == GOOD, F.lit(False))
    )
    return rows.select(*[F.col(p).alias(c) for p, c in zip(places, passed)], *_RESULTS)


def _judged(
    docs: DataFrame,
    passed: Sequence[str],
    trusted: DataFrame,
    doc_id: str,
    order: int,
    quantile: float,
    suspect_quantile: float,
    folds: int,
    rejected: DataFrame | None,
) -> tuple[DataFrame, list[str], DataFrame]:
    """The verdicts beside the columns ``passed``, the names those go by meanwhile, the ids read.

    ``trusted`` is left to the caller: it takes a join of all rows, with the columns passed.
    """
    places = [f"c{i}" for i in range(len(passed))]
    kinds = [GOOD] if rejected is None else [GOOD, BOTH]
    ids = cut_lineage(
        trusted.select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL").distinct(), "kn-ids"
    )
    taught = ids.withColumn("_kind", F.lit(GOOD))
    if rejected is not None:
        bad = rejected.select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL")
        bad = bad.join(ids, "_id", "left_anti").distinct()
        taught = cut_lineage(
            taught.unionByName(bad.withColumn("_kind", F.lit(BOTH))), "kn-taught"
        )
    fold = F.pmod(F.xxhash64(doc_id), F.lit(folds))
    own = docs.select(
        *[F.col(c).alias(p) for p, c in zip(places, passed)],
        F.col(doc_id).alias("_key"),
        fold.alias("_fold"),
        "lang",
        "text",
    )
    # One pass counts all text that any model reads; one chain of joins trains all models.
    read = own.select("_key", "_fold", "lang", "text")
    counts = _counted(read, taught, order, folds, kinds)
    names = [[f"_{kind}{f}" for kind in kinds] for f in range(folds)]
    model = cut_lineage(train(counts, order, [m for used in names for m in used]), "kn-model")

    def steps(nll):
        return F.when(F.col("_s.chars") > 0, F.round(nll / F.col("_s.chars") / STEP).cast("long"))

    gain = F.col("_s.nll") - F.col(f"_s.{_losses(names)[-1]}")

    def measured(part: DataFrame) -> DataFrame:
        return part.select(
            *places,
            "_key",
            F.col("lang").alias("_lang"),
            F.coalesce("_s.chars", F.lit(0)).alias("n_scored"),
            steps(F.col("_s.nll")).alias("_p"),
            steps(gain).alias("_c"),
        )

    parts = _scored_parts(own, model, order, BROADCAST_BYTES, names, F.col("_fold"))
    rows = _written(((measured(part), sent) for part, sent in parts), "kn-scored")
    good = taught.where(F.col("_kind") == GOOD)
    known = rows.where("_p IS NOT NULL").select("_key", F.col("_lang").alias("lang"), "_p", "_c")
    known = known.join(_if_small(good), F.col("_key") == F.col("_id"))
    # Two bounds share what one alone may cost of the trusted documents.
    strict = suspect_quantile if rejected is None else (1 + suspect_quantile) / 2
    limits = thresholds(known, {"_limit": quantile, "_strict": strict})
    limits = limits.withColumnRenamed("lang", "_l")
    gains = known.select("lang", F.col("_c").alias("_p")).where("_p IS NOT NULL")
    gains = thresholds(gains, {"_most": strict}).withColumnRenamed("lang", "_m")
    rows = rows.join(F.broadcast(limits), F.col("_lang").eqNullSafe(F.col("_l")), "left")
    rows = rows.join(F.broadcast(gains), F.col("_lang").eqNullSafe(F.col("_m")), "left")
    odd = F.coalesce(F.col("_p") > F.col("_strict"), F.lit(False))
    done = rows.select(
        *places,
        "_key",
        "n_scored",
        (F.col("_p") * STEP).alias("log_perplexity"),
        (F.col("_limit") * STEP).alias("threshold"),
        F.coalesce(F.col("_p") <= F.col("_limit"), F.lit(True)).alias("kept"),
        (odd | F.coalesce(F.col("_c") > F.col("_most"), F.lit(False))).alias("suspect"),
    )
    return done, places, taught


def _written(parts: Iterable[tuple[DataFrame, Sequence[Broadcast]]], label: str) -> DataFrame:
    """All parts, written one after the other; the models sent for a part are let go after it."""
    path = ""
    for part, sent in parts:
        path = path or scratch_path(part.sparkSession, label)
        part.write.mode("append").parquet(path)
        for models in sent:
            models.destroy()
    return part.sparkSession.read.schema(part.schema).parquet(path)


def _ids_bytes(ids: DataFrame) -> int:
    size = F.coalesce(F.sum(F.octet_length(F.col("_id").cast("string")) + 32), F.lit(0))
    return ids.agg(size).first()[0]


def _if_small(ids: DataFrame) -> DataFrame:
    """A broadcast hint when the ids, measured as they are, weigh little."""
    return F.broadcast(ids) if _ids_bytes(ids) <= BROADCAST_BYTES else ids


def thresholds(rows: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """``lang`` and, by name, the least step that at least each quantile of the rows reach.

    Exact over all rows: they are counted by step first, and a language has few steps.
    """
    steps = rows.groupBy("lang", "_p").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("lang")
    upto = whole.orderBy("_p")
    ranked = steps.withColumn("_upto", F.sum("n").over(upto)).withColumn(
        "_all", F.sum("n").over(whole)
    )
    return ranked.groupBy("lang").agg(
        *[
            F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("_p"))).alias(name)
            for name, q in quantiles.items()
        ]
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good and not toxic."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")


def rejected_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as toxic."""
    return labels.where("toxic = 1").select("doc_id")


def verdicts(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """What the query reports and the pipeline acts on: ``judged`` by the given labels."""
    return judged(
        docs, trusted_ids(labels), keep_text=keep_text, rejected=rejected_ids(labels)
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that ``verdicts`` calls suspect; all columns as they were."""
    columns = docs.columns
    rows, places, _ = _judged(
        docs,
        columns,
        trusted_ids(labels),
        "doc_id",
        ORDER,
        QUANTILE,
        SUSPECT_QUANTILE,
        FOLDS,
        rejected_ids(labels),
    )
    kept = rows.where("NOT suspect")
    return kept.select(*[F.col(p).alias(c) for p, c in zip(places, columns)])
