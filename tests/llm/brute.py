"""Row-by-row versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                odd = [int(d) for d in digits[::-1]]
                total = sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    order = list(BASE)
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def least_capacity(sizes, shards):
    def needed(capacity):
        n, room = 0, 0
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    capacity = max([*sizes, -(-sum(sizes) // shards)]) if sizes else 0
    while sizes and needed(capacity) > shards:
        capacity += 1
    return capacity


def best_fit(lengths, pick):
    """Piece by piece: ``[(length, bin)]`` and the bins' ``[size, used]``."""
    bins, placed = [], []
    for length in sorted(lengths, reverse=True):
        room = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= length]
        if room:
            i = min(room)[1]
        else:
            i = len(bins)
            bins.append([pick(length), 0])
        bins[i][1] += length
        placed.append((length, i))
    return placed, bins


def chosen_bins(lengths, sizes, bin_cost):
    """Best fit piece by piece, each bin's size chosen when it opens; used room of each bin.

    A bin is judged by filling it with the longest pieces that fit and that no earlier bin was
    judged by; pieces of the length in hand are all that are left of it.
    """
    waiting = sorted(lengths, reverse=True)
    free = list(waiting)
    bins = []
    for k, length in enumerate(waiting):
        room = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= length]
        if not room:
            free = [x for x in free if x != length] + [x for x in waiting[k:] if x == length]
            free.sort(reverse=True)
            options = []
            for size in sizes:
                own, taken = size, []
                for x in free:
                    if x <= min(own, length):
                        own -= x
                        taken.append(x)
                if size >= length:
                    options.append(((size + bin_cost) / (size - own), size, taken))
            _, size, taken = min(options)
            for x in taken:
                free.remove(x)
            room = [(size, len(bins))]
            bins.append([size, 0])
        bins[min(room)[1]][1] += length
    return [used for _, used in bins]


def secret_spans(text):
    """The words of a secret after each cue, every cue scanned on its own."""
    spans, done = [], 0
    cues = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")
    for at in range(len(text)):
        for cue in cues:
            m = re.match(
                re.escape(cue)
                + r"[\x20]?[:=][\x20]?[\"']?([A-Za-z0-9_\-./+=~!@#$%^&*]{6,})",
                text[at:],
                re.I | re.A,
            )
            value = m.group(1).rstrip(".!") if m else ""
            if at >= done and len(value) >= 6 and re.search("[0-9]", value):
                start = at + m.start(1)
                done = start + len(value)
                spans.append(("secret", start, done))
    return spans


def url_spans(text):
    """Addresses from a scheme on, every scheme scanned on its own."""
    host = re.compile(
        r"(?:[^\s/@]*@)?(?:[\w-]+\.)+\w{2,}|(?:[^\s/@]*@)?localhost\b"
    )
    spans, done = [], 0
    for at in range(len(text)):
        m = re.compile(r"https?://|ftp://|www\.", re.I | re.A).match(text, at)
        if not m or at < done or (at and re.match("[A-Za-z0-9_]", text[at - 1])):
            continue
        tail = re.compile(r"[^\s<>\"'`|{}\\^]+").match(text, m.end())
        if tail and host.match(text, at if m.group()[-1] == "." else m.end()):
            body = tail.group().rstrip(".,;:!?)]*_")
            if body:
                done = m.end() + len(body)
                spans.append(("url", at, done))
    return spans


def tokens(word, scores, byte):
    best = [(0, 0)]
    for i in range(1, len(word) + 1):
        options = []
        if word[i - 1] not in scores:
            n = len(word[i - 1].encode())
            options.append((best[i - 1][0] + byte * n, -(-best[i - 1][1] + n)))
        for a in range(i):
            if word[a:i] in scores:
                options.append((best[a][0] + scores[word[a:i]], best[a][1] - 1))
        best.append(max(options))
    return -best[-1][1]


class KneserNey:
    """The textbook recursion over dictionaries."""

    def __init__(self, words, order):
        self.order = order
        top = Counter()
        for w in words:
            p = "\x02" * (order - 1) + w + "\x03"
            top.update(p[i : i + order] for i in range(len(p) - order + 1))
        raw, self.counts = {order: top}, {order: dict(top)}
        for k in range(order - 1, 0, -1):
            raw[k], kinds = Counter(), Counter()
            for g, n in raw[k + 1].items():
                raw[k][g[1:]] += n
                kinds[g[1:]] += 1
            self.counts[k] = {
                g: raw[k][g] if g[0] == "\x02" else kinds[g] for g in kinds
            }
        self.discounts = {}
        self.contexts = {}
        for k in range(1, order + 1):
            n = Counter(self.counts[k].values())
            d = []
            for i in (1, 2, 3):
                if n[1] and n[i] and n[i + 1]:
                    y = n[1] / (n[1] + 2 * n[2])
                    v = i - (i + 1) * y * n[i + 1] / n[i]
                else:
                    v = i * 0.5
                d.append(max(0.05, min(i - 0.05, v)))
            self.discounts[k] = d
            by = defaultdict(list)
            for g, c in self.counts[k].items():
                by[g[:-1]].append(c)
            self.contexts[k] = by

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / (len(self.counts[1]) + 1)
        own = self.contexts[k].get(g[:-1])
        if not own:
            return self.p(g[1:])
        cut = lambda c: self.discounts[k][min(c, 3) - 1]
        c = self.counts[k].get(g, 0)
        direct = (c - cut(c)) / sum(own) if c else 0.0
        return direct + sum(map(cut, own)) / sum(own) * self.p(g[1:])

    def nll(self, word):
        p = "\x02" * (self.order - 1) + word + "\x03"
        return -sum(
            math.log(self.p(p[i : i + self.order])) for i in range(len(p) - self.order + 1)
        )
