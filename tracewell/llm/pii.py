"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and
the cues of identifiers. At each anchor a local parser expands to both sides, validates what it
found and gives a span. A run of characters that was read in vain is remembered up to its end, so
a text that only repeats a cue costs time in proportion to its length, like any other.

Defined cases: a NULL text is empty and has no span; spans count code points with exclusive
end; repeated rows are each handled on their own; other columns are not looked at; texts of any
length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account", "secret")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = _LOCAL - set(".%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_TAIL = re.compile(r"[^\s<>\"'`|{}\\^]+")
_HOST = re.compile(r"(?:[\w-]+\.)+\w{2,}")
_LOCALHOST = re.compile(r"localhost\b")
_LABELS = re.compile(r"(?:[\w-]+\.)*[\w-]*")
_USER_END = re.compile(r"[\s/@]")
_MAILBOX = re.compile(rf"[A-Za-z0-9._%+-]+@{_DOMAIN.pattern}")
_ASSIGNED = re.compile(r"[\x20]?[:=][\x20]?[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9_\-./+=~!@#$%^&*]{6,}")
_NUMBER = re.compile(
    r"(?:[\x20](?:no|nr|number|id))?[.:#=]?[\x20]?[:#]?[\x20]?"
    r"((?:[A-Z]{2})?[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])"
)
_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
_SECRETS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")
_ACCOUNTS = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")


_BUILT: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    """The automaton of all anchors, built once in a task."""
    if _BUILT:
        return _BUILT[0]
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign in "@+" else "0", 1))
    for kind, cues in (("url", _SCHEMES), ("secret", _SECRETS), ("account", _ACCOUNTS)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.add_word("akia", ("key", 4))
    found.make_automaton()
    _BUILT.append(found)
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """ISO 13616 check of an IBAN without blanks."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class _Finder:
    """The parsers of one text, with the end of the last match or attempt of each kind."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans: list[tuple[str, int, int]] = []
        self.done = dict.fromkeys((*KINDS, "ip_chain", "card_chain", "no_secret"), 0)
        self.no_host = {"user": (0, 0), "plain": (0, 0)}
        self.user_run = (0, 0)

    def put(self, kind: str, start: int, end: int) -> None:
        self.spans.append((kind, start, end))
        self.done[kind] = end

    def email(self, at: int) -> None:
        start, least = at, self.done["email"]
        while start > least and self.text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(self.text, at + 1)):
            self.put("email", start, m.end())

    def digits(self, at: int) -> None:
        if at >= self.done["ip_chain"]:
            m = _DOTTED.match(self.text, at)
            self.done["ip_chain"] = m.end()
            parts = m.group().split(".")
            begin = at
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = begin + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                    self.put("ip", begin, end)
                begin = end + 1
        if at >= self.done["card_chain"]:
            m = _SPACED.match(self.text, at)
            self.done["card_chain"] = m.end()
            if m.end() - at >= 14:
                number = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(number) <= 19 and luhn(number):
                    self.put("card", at, m.end())

    def phone(self, at: int) -> None:
        if at >= self.done["phone"] and (m := _PHONE.match(self.text, at)):
            self.done["phone"] = m.end()
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                self.put("phone", at, m.end())

    def url(self, begin: int, end: int) -> None:
        if begin < self.done["url"] or (begin and self.text[begin - 1] in _WORD):
            return
        if self.text[begin:end].lower() == "mailto:":
            if m := _MAILBOX.match(self.text, end):
                self.put("url", begin, m.end())
            return
        host = end if self.text[end - 1] == "/" else begin
        if self.has_host(host) and (m := _URL_TAIL.match(self.text, end)):
            body = m.group().rstrip(".,;:!?)]*_")
            if body:
                self.put("url", begin, end + len(body))

    def has_host(self, at: int) -> bool:
        """Whether a host stands at ``at``, or after the ``user@`` that begins there."""
        if not self.user_run[0] <= at < self.user_run[1]:
            m = _USER_END.search(self.text, at)
            self.user_run = (at, m.start() if m else len(self.text))
        stop = self.user_run[1]
        after_user = self.text[stop : stop + 1] == "@" and self.names_host(stop + 1, "user")
        return after_user or self.names_host(at, "plain")

    def names_host(self, at: int, which: str) -> bool:
        if _LOCALHOST.match(self.text, at):
            return True
        first, last = self.no_host[which]
        if first <= at < last:
            return False  # what has no host from its first label has none from a later one
        if _HOST.match(self.text, at):
            return True
        self.no_host[which] = (at, _LABELS.match(self.text, at).end())
        return False

    def secret(self, begin: int, end: int) -> None:
        if begin < self.done["secret"] or not (m := _ASSIGNED.match(self.text, end)):
            return
        # A run without a secret has none from any of its later characters.
        start = m.end()
        if start < self.done["no_secret"] or not (m := _SECRET.match(self.text, start)):
            return
        value = m.group().rstrip(".!")
        if len(value) >= 6 and any(c.isdigit() for c in value):
            self.put("secret", start, start + len(value))
        else:
            self.done["no_secret"] = m.end()

    def key(self, begin: int) -> None:
        if begin >= self.done["secret"] and not (begin and self.text[begin - 1] in _WORD):
            if m := _KEY.match(self.text, begin):
                self.put("secret", begin, m.end())

    def account(self, begin: int, end: int) -> None:
        if begin < self.done["account"] or (begin and self.text[begin - 1] in _WORD):
            return
        if m := _NUMBER.match(self.text, end):
            number = m.group(1).replace(" ", "").replace("-", "")
            named = number[:2].isalpha()
            if iban(number) if named else sum(c.isdigit() for c in number) >= 6:
                self.put("account", m.start(1), m.end(1))


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    found = _Finder(text)
    # Lower-casing ASCII only keeps every position.
    for last, (kind, size) in _automaton().iter(text.encode().lower().decode()):
        at = last + 1 - size
        if kind == "0":
            found.digits(at)
        elif kind == "@":
            found.email(at)
        elif kind == "+":
            found.phone(at)
        elif kind == "key":
            found.key(at)
        else:
            getattr(found, kind)(at, last + 1)
    return sorted(found.spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str | None) -> str | None:
    """``text`` with every span, overlapping ones as one, replaced by ``<KIND>``."""
    spans = spans_of(text)
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = spans_of(text)
        base = [s for s in spans if s[0] in BASE]
        counts = [sum(s[0] == k for s in base) for k in BASE]
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        rows.append((*counts, digest, _joined(spans)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])


def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(redacted, na_action="ignore")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts and spans of its personal data."""
    find_udf = F.pandas_udf(_found, _FOUND)
    found = docs.select(F.col(doc_id).alias("doc_id"), find_udf(F.col(text)).alias("_f"))
    return found.select("doc_id", "_f.*")


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; ``n_chars`` follows, if it exists."""
    masked = docs.withColumn(text, F.pandas_udf(_masked, "string")(F.col(text)))
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        masked = masked.withColumn(n_chars, F.length(text).cast(kind))
    return masked.select(*docs.columns)
