"""Token counts under a unigram vocabulary, with scores shared along a trie.

A task gathers the distinct pre-tokens of its documents and walks them in sorted order, which
is a depth-first walk of their trie: characters shared with the pre-token before keep their
forward scores, so each node of the trie is computed once. The count at the terminal node is
stored and looked up for every occurrence.

Scores follow Zipf's law over the ranks of the vocabulary file, in whole micro-nats, so equal
paths are equal exactly; among paths of the best score the one of fewest tokens counts.

Defined cases: a pre-token is a run of non-blanks behind a word mark; a NULL or blank text has
none and no tokens; a character without a piece is spelled in UTF-8 bytes, a token each;
repeated rows are counted one by one; other columns are not looked at; an empty table gives no
rows. Of a pre-token beyond ``SHARED`` characters only the first so many are shared; the rest is
scored with memory for the longest piece alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import received, send

MARK = "▁"
MICRO = 1_000_000
#: Added to ranks in Zipf's law, and the extra cost of a byte in nats.
SHIFT = 2.7
BYTE_COST = 10.0
#: Counts a task remembers before it starts over.
REMEMBERED = 1 << 20
#: Depth to which prefixes are shared, and length of the pre-tokens that are remembered.
SHARED = 1 << 12


def default_vocabulary() -> str:
    """Path of the public vocabulary file used where none is named."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def read_pieces(path: str) -> list[str]:
    """Normal pieces of a sentencepiece file, most frequent first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not any(f(i) for f in special)
    ]


def zipf_scores(pieces: list[str]) -> dict[str, int]:
    """Log-probability of each piece by its rank, in micro-nats."""
    total = math.log(sum(1 / (r + SHIFT) for r in range(len(pieces))))
    return {p: -round(MICRO * (math.log(r + SHIFT) + total)) for r, p in enumerate(pieces)}


class Trie:
    """The vocabulary as nested dicts; a piece's score stands under the empty string."""

    def __init__(self, scores: dict[str, int]) -> None:
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.byte = min(scores.values(), default=0) - round(BYTE_COST * MICRO)


def count_tokens(words: Iterable[str], trie: Trie) -> dict[str, int]:
    """Tokens of each distinct word, each shared prefix scored once."""
    counts = {}
    root, byte = trie.root, trie.byte
    best, tokens = [0], [0]
    open_at: list[list[tuple[int, dict]]] = [[(0, root)]]
    before = ""
    for word in sorted(set(words)):
        shared, deep = 0, min(len(word), SHARED)
        for a, b in zip(before, word[:deep]):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :], open_at[shared + 1 :]
        for i in range(shared, deep):
            c = word[i]
            alone = root.get(c)
            score = n = None
            if alone is None or "" not in alone:
                size = len(c.encode())
                score, n = best[i] + byte * size, tokens[i] + size
            states = []
            for start, node in open_at[i]:
                child = node.get(c)
                if child is not None:
                    states.append((start, child))
                    own = child.get("")
                    if own is not None:
                        own += best[start]
                        used = tokens[start] + 1
                        if score is None or own > score or (own == score and used < n):
                            score, n = own, used
            best.append(score)
            tokens.append(n)
            states.append((i + 1, root))
            open_at.append(states)
        if deep < len(word):
            open_now = [(best[start], tokens[start], node) for start, node in open_at[deep]]
            counts[word] = _rest(word, deep, best[deep], tokens[deep], open_now, trie)
        else:
            counts[word] = tokens[deep]
        before = word[:deep]
    return counts


def _rest(
    word: str, at: int, best: int, used: int, states: list[tuple[int, int, dict]], trie: Trie
) -> int:
    """Tokens of ``word`` whose first ``at`` characters have the score ``best`` by ``used`` tokens.

    A state is a piece begun earlier: score and tokens before it, and its node in the trie.
    """
    root, byte = trie.root, trie.byte
    for i in range(at, len(word)):
        c = word[i]
        alone = root.get(c)
        score = n = None
        if alone is None or "" not in alone:
            size = len(c.encode())
            score, n = best + byte * size, used + size
        going = []
        for before, count, node in states:
            child = node.get(c)
            if child is not None:
                going.append((before, count, child))
                own = child.get("")
                if own is not None:
                    own += before
                    if score is None or own > score or (own == score and count + 1 < n):
                        score, n = own, count + 1
        best, used = score, n
        going.append((best, used, root))
        states = going
    return used


def _counter(sent):
    held: list[Trie] = []
    known: dict[str, int] = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Trie(received(sent)))
        found = [(t or "").split() for t in texts]
        new = {w for words in found for w in words}.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {w for words in found for w in words}
        counts = count_tokens([MARK + w for w in new], held[0])
        known.update((w[1:], n) for w, n in counts.items())
        result = pd.DataFrame(
            {
                "n_pretokens": [len(words) for words in found],
                "n_tokens": [sum(map(known.__getitem__, words)) for words in found],
            }
        )
        for w in new:
            if len(w) > SHARED:
                del known[w]
        return result

    return run


def token_counts(
    docs: DataFrame,
    scores: dict[str, int] | None = None,
    vocabulary: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every document.

    ``scores`` are micro-nats by piece; else they come from the file ``vocabulary``.
    """
    if scores is None:
        scores = zipf_scores(read_pieces(vocabulary or default_vocabulary()))
    count = F.pandas_udf(
        _counter(send(docs.sparkSession, scores)), "n_pretokens long, n_tokens long"
    )
    counted = docs.select(F.col(doc_id).alias("doc_id"), count(F.col(text)).alias("_n"))
    return counted.select("doc_id", "_n.*")
