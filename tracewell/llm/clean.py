"""Line-first cleaning, in DataFrame functions only.

Every line with a word is judged by rules of punctuation, navigation and boilerplate; failing
lines are taken out; a document that loses too much of its text that way is rejected.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a NULL or blank text has no words, fails the
base rules and is not kept; rows are judged one by one, so repeated rows get equal answers;
columns of the input named like a result are replaced, all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\f\r"
_BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
SHINGLE = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document verdict."""

    #: A line fails with more of these signs than so many hundredths of its words.
    max_symbols_pct: int = 30
    #: ... or with more exclamation and question marks than that.
    max_shouts_pct: int = 60
    #: ... or with so many separators of menu entries, in a line of any length.
    max_separators: int = 2
    #: ... or when it holds one of these phrases, in any case, and has at most so many words.
    boilerplate: tuple[str, ...] = (
        "all rights reserved",
        "cookie policy",
        "accept cookies",
        "privacy policy",
        "terms of service",
        "terms of use",
        "enable javascript",
        "sign in",
        "log in",
        "subscribe to our newsletter",
        "licensed under",
        "share on",
        "read more",
        "click here",
        "skip to content",
    )
    max_boilerplate_words: int = 40
    #: A document is rejected when removed lines hold more of its word characters than that.
    max_lost_pct: int = 30
    min_words: int = 20
    max_repeat_pct: int = 30


def words_of(text: Column) -> Column:
    """Words of a text without NULL, in order."""
    return F.filter(F.split(F.regexp_replace(text, _BLANK_RUN, " "), " "), lambda w: w != "")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, signs, ""))


def judged(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with base counts, line counts, ``clean_text`` and ``kept``."""
    results = [
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "n_lines",
        "n_bad_lines",
        "lost_chars",
        "clean_text",
        "kept",
    ]
    # Columns of the input go by numbers meanwhile, so no helper column is named like one.
    kept_names = [c for c in docs.columns if c not in results]
    passed = [f"c{i}" for i in range(len(kept_names))]
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        *[F.col(f"`{c}`").alias(p) for p, c in zip(passed, kept_names)],
        words_of(body).alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0).alias(
            "_lines"
        ),
        body.alias("_body"),
    )
    step = step.select(
        *passed,
        "_words",
        "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_body"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes("_words").alias("_hashes"),
        F.filter("_lines", lambda x: ~_bad_line(x, rules)).alias("_good"),
    )
    step = step.select(
        *passed,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "_lines",
        "_good",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(
                F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ).alias("_sorted"),
    )
    step = step.withColumn("_places", _places_of_repeats("_sorted"))
    lost = F.col("word_chars") - _word_chars(F.array_join("_good", ""))
    step = step.select(
        *passed,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _covered("_places").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_bad_lines"),
        lost.cast("long").alias("lost_chars"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct
    )
    enough = F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_pct
    step = step.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & enough
    )
    others = [c for c in step.columns if c not in passed]
    return step.select(*[F.col(p).alias(c) for p, c in zip(passed, kept_names)], *others)


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _BLANK_RUN, ""))


def _bad_line(line: Column, rules: Rules) -> Column:
    """Whether a line with a word fails a rule."""
    trimmed = F.btrim(line, F.lit(_BLANKS))
    n_words = F.size(F.split(trimmed, _BLANK_RUN))
    symbols = _count(line, SYMBOLS) * 100 > n_words * rules.max_symbols_pct
    shouts = _count(line, "[!?]") * 100 > n_words * rules.max_shouts_pct
    menu = _count(line, "[|»›·•]") > rules.max_separators
    phrases = "(?i)" + "|".join(rules.boilerplate)
    legal = (n_words <= rules.max_boilerplate_words) & line.rlike(phrases)
    return symbols | shouts | menu | legal


def _window_hashes(words: str) -> Column:
    """64-bit hashes of all windows of eight words; empty for shorter texts."""
    w = F.col(words)
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]),
    )
    return F.when(F.size(w) >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))


def _places_of_repeats(ordered: str) -> Column:
    """Sorted starts of the windows that stand next to an equal one in hash order."""
    s = F.col(ordered)
    hits = F.filter(
        F.transform(
            s,
            lambda x, j: F.when(
                (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return F.sort_array(hits)


def _covered(places: str) -> Column:
    """Words under windows that start at ``places``: gaps to the next start, eight at most."""
    p = F.col(places)
    total = F.aggregate(
        F.transform(
            p, lambda i, j: F.least(F.lit(SHINGLE), F.coalesce(F.get(p, j + 1) - i, F.lit(99)))
        ),
        F.lit(0).cast("long"),
        lambda acc, n: acc + n,
    )
    return F.coalesce(total, F.lit(0).cast("long"))
