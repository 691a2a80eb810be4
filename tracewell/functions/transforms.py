"""The scalar transforms a mapping document may name, as Column expressions.

Each transform takes a present (non-NULL) VARIANT value. It yields a typed cell and a flag
that tells values it cannot handle from values that legitimately have no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import paths


@dataclass(frozen=True)
class Cell:
    """A value with its Spark type: variant, string, long, double or timestamp."""

    type: str
    value: Column
    failed: Column


@dataclass(frozen=True)
class Transform:
    build: Callable[[Column, dict[str, Any], Column], Cell]
    check: Callable[[dict[str, Any]], list[str]] = lambda args: []


NO_SOURCE = ("const", "coalesce")


def _never() -> Column:
    return F.lit(False)


def _cell(type_: str, source: Column, value: Column) -> Cell:
    """A transform that always has a result: no result means it failed."""
    return Cell(type_, value, source.isNotNull() & value.isNull())


def _text_only(source: Column) -> Column:
    return F.when(paths.is_text(source), F.try_variant_get(source, "$", "string"))


def _identity(source: Column, args: dict, root: Column) -> Cell:
    return Cell("variant", source, _never())


def to_long(source: Column) -> Column:
    """Integer value: numbers are truncated, text must hold an integer, booleans are 0 or 1."""
    return F.try_variant_get(source, "$", "bigint")


def _to_int(source: Column, args: dict, root: Column) -> Cell:
    return _cell("long", source, to_long(source))


# Text that is a number; a cast alone would also take the type suffixes of literals.
_FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def to_double(source: Column) -> Column:
    """Floating-point value of a number, boolean or numeric text."""
    value = F.try_variant_get(source, "$", "double")
    text = _text_only(source)
    return F.when(text.isNull() | text.rlike(_FLOAT_TEXT), value)


def _to_float(source: Column, args: dict, root: Column) -> Cell:
    return _cell("double", source, to_double(source))


# First and last second of the years 1 to 9999.
_FIRST_SECOND, _LAST_SECOND = -62_135_596_800, 253_402_300_799
# Date parts with a pattern letter of the same meaning.
STRPTIME_PARTS = {
    "%Y": "yyyy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%y": "yy",
    "%j": "DDD",
    "%z": "xx",
    "%%": "'%'",
}

ISO_DATE = r"\d{4}-\d{2}-\d{2}"
ISO_TIME = r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
ISO_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?)"


_ONE_OR_TWO_DIGITS = {"%m", "%d", "%H", "%I", "%M", "%S"}


def spark_pattern(strptime: str) -> str:
    """The datetime pattern that reads what a strptime format reads.

    Numbers may have one digit or two, unless another number touches them.
    """
    tokens = re.findall(r"%.|[A-Za-z]+|'|[^%A-Za-z']+", strptime, flags=re.DOTALL)
    out: list[str] = []
    for i, token in enumerate(tokens):
        around = tokens[max(0, i - 1) : i] + tokens[i + 1 : i + 2]
        touching = any(t.startswith("%") and t not in ("%p", "%z", "%%") for t in around)
        if token.startswith("%"):
            if token not in STRPTIME_PARTS:
                raise ValueError(f"unsupported date part {token}")
            part = STRPTIME_PARTS[token]
            out.append(part[:1] if token in _ONE_OR_TWO_DIGITS and not touching else part)
        elif token == "'":
            out.append("''")
        else:
            out.append(f"'{token}'" if token.isalpha() else token)
    return "".join(out)


def parse_iso(text: Column, offset_required: bool) -> Column:
    """Extended ISO text to an instant; text without an offset is UTC or, if required, NULL."""
    if offset_required:
        shape = f"^{ISO_DATE}.{ISO_TIME}{ISO_OFFSET}$"
    else:
        shape = f"^{ISO_DATE}(?:.{ISO_TIME}{ISO_OFFSET}?)?$"
    spaced = F.regexp_replace(text, f"^({ISO_DATE}).", "$1T")
    dotted = F.regexp_replace(spaced, ",", ".")
    colon = F.regexp_replace(dotted, r"([+-]\d{2})(\d{2})$", "$1:$2")
    full = F.when(F.length(text) == 10, text).otherwise(colon)
    hours = F.regexp_replace(full, r"(T.*[+-]\d{2})$", "$1:00")
    return F.when(text.rlike(shape), hours.try_cast("timestamp"))


def _from_seconds(seconds: Column) -> Column:
    inside = seconds.between(_FIRST_SECOND, _LAST_SECOND)
    return F.when(inside, F.timestamp_micros(F.rint(seconds * 1_000_000).cast("long")))


def _to_instant(source: Column, args: dict, root: Column) -> Cell:
    unit = args.get("unit")
    if unit == "epoch_s":
        moment = _from_seconds(F.try_variant_get(source, "$", "double"))
    elif unit == "epoch_ms":
        moment = _from_seconds(F.try_variant_get(source, "$", "double") / 1000)
    elif args.get("input_format"):
        pattern = spark_pattern(args["input_format"])
        moment = F.try_to_timestamp(paths.as_text(source), F.lit(pattern))
    else:
        moment = parse_iso(paths.as_text(source), offset_required=False)
    return _cell("timestamp", source, moment)


def _check_instant(args: dict) -> list[str]:
    if args.get("unit") not in ("epoch_s", "epoch_ms", "iso"):
        return ["`to_iso8601` needs unit epoch_s, epoch_ms or iso"]
    if args.get("input_format"):
        try:
            spark_pattern(args["input_format"])
        except ValueError as error:
            return [str(error)]
    return []


def _lower(source: Column, args: dict, root: Column) -> Cell:
    return _cell("string", source, F.lower(_text_only(source)))


def _upper(source: Column, args: dict, root: Column) -> Cell:
    return _cell("string", source, F.upper(_text_only(source)))


def _trim(source: Column, args: dict, root: Column) -> Cell:
    return _cell("string", source, F.regexp_replace(_text_only(source), r"(?U)^\s+|\s+$", ""))


def _json_stringify(source: Column, args: dict, root: Column) -> Cell:
    """Compact JSON with sorted keys; characters beyond ASCII become \\u escapes."""
    compact = F.to_json(source)
    characters = F.regexp_extract_all(compact, F.lit("(?s)."), F.lit(0))
    units = F.transform(
        characters,
        lambda c: F.when(
            c.rlike(r"[^\x00-\x7f]"),
            F.regexp_replace(
                F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1"
            ),
        ).otherwise(c),
    )
    plain = ~compact.rlike(r"[^\x00-\x7f]")
    return _cell("string", source, F.when(plain, compact).otherwise(F.array_join(units, "")))


def literal(value: Any) -> Column:
    """A JSON value as a constant VARIANT; null is NULL."""
    if value is None:
        return F.lit(None).cast("variant")
    return F.parse_json(F.lit(json.dumps(value)))


def _const(source: Column, args: dict, root: Column) -> Cell:
    return Cell("variant", literal(args["value"]), _never())


def _coalesce(source: Column, args: dict, root: Column) -> Cell:
    """First present top-level field of the record; no dotted paths, no row scope."""
    return Cell("variant", F.coalesce(*[paths.field(root, n) for n in args["fields"]]), _never())


def _check_coalesce(args: dict) -> list[str]:
    fields = args.get("fields")
    ok = isinstance(fields, list) and fields and all(isinstance(f, str) for f in fields)
    return [] if ok else ["`coalesce` needs args.fields, a list of names"]


def _map_enum(source: Column, args: dict, root: Column) -> Cell:
    """Exact lookup of text, and of booleans as true/false; numbers never match."""
    kind = paths.kind(source)
    key = F.when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(source, "$", "string"))
    mapped = F.lit(None).cast("variant")
    for name, value in reversed(list(args["mapping"].items())):
        mapped = F.when(key == F.lit(name), literal(value)).otherwise(mapped)
    known = key.isin(*args["mapping"]) if args["mapping"] else _never()
    value = F.when(known, mapped).otherwise(literal(args.get("default")))
    nested = F.coalesce(kind.isin("OBJECT", "ARRAY"), _never())
    return Cell("variant", F.when(source.isNotNull() & ~nested, value), nested)


def _check_map_enum(args: dict) -> list[str]:
    return [] if isinstance(args.get("mapping"), dict) else ["`map_enum` needs args.mapping"]


def _split(source: Column, args: dict, root: Column) -> Cell:
    index = args["index"]
    parts = F.split(_text_only(source), re.escape(args["sep"]), -1)
    return _cell(
        "string", source, F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))
    )


def _check_split(args: dict) -> list[str]:
    problems = []
    if not isinstance(args.get("sep"), str) or not args.get("sep"):
        problems.append("`split` needs a non-empty args.sep")
    if not isinstance(args.get("index"), int):
        problems.append("`split` needs an integer args.index")
    return problems


_UNKNOWN_GROUP = re.compile(r"\(\?(?:\(|[a-zA-Z]*[aL])")


def java_pattern(compiled: re.Pattern) -> str:
    """The pattern for Java's engine, with the same groups, classes and line ends.

    Named groups become numbered ones and references to them numbers, classes cover all
    scripts, only ``\\n`` ends a line, and brackets inside a class stand for themselves.
    """
    source, out, i, in_class = compiled.pattern, [], 0, False
    while i < len(source):
        rest = source[i:]
        if source[i] == "\\":
            out.append(r"\z" if rest.startswith(r"\Z") else rest[:2])
            i += 2
        elif in_class:
            opened = source[i - 1] == "[" or source[i - 2 : i] == "[^"
            in_class = source[i] != "]" or opened
            out.append("\\" + source[i] if source[i] in "[&" or (source[i] == "]" and opened) else source[i])
            i += 1
        elif named := re.match(r"\(\?P<\w+>", rest):
            out.append("(")
            i += named.end()
        elif known := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"(?:\\{compiled.groupindex[known.group(1)]})")
            i += known.end()
        elif flags := re.match(r"\(\?([a-zA-Z]*u[a-zA-Z]*)", rest):
            out.append("(?" + flags.group(1).replace("u", ""))
            i += flags.end()
        elif upto := re.match(r"\{,(\d+)\}", rest):
            out.append(f"{{0,{upto.group(1)}}}")
            i += upto.end()
        else:
            in_class = source[i] == "["
            out.append(source[i])
            i += 1
    return "(?Ud)" + "".join(out)


def _regex_extract(source: Column, args: dict, root: Column) -> Cell:
    """A group of the first match; no match gives no result, a missing group is an error."""
    text = _text_only(source)
    wrong_type = source.isNotNull() & text.isNull()
    none = F.lit(None).cast("string")
    try:
        compiled = re.compile(args["pattern"])
    except re.error:
        return Cell("string", none, source.isNotNull())
    group = args.get("group", 1)
    pattern = java_pattern(compiled)
    matched = text.rlike(pattern)
    index = compiled.groupindex.get(group) if isinstance(group, str) else group
    if index is None or not 0 <= index <= compiled.groups:
        return Cell("string", none, wrong_type | F.coalesce(matched, _never()))
    return Cell("string", F.when(matched, F.regexp_extract(text, pattern, index)), wrong_type)


def _check_regex(args: dict) -> list[str]:
    problems = []
    if not isinstance(args.get("pattern"), str):
        problems.append("`regex_extract` needs args.pattern")
    elif _UNKNOWN_GROUP.search(args["pattern"]):
        problems.append("`regex_extract` takes no conditional groups and no ASCII or locale flag")
    if not isinstance(args.get("group", 1), (int, str)):
        problems.append("`regex_extract` needs a group number or name")
    return problems


def _cents_to_usd(source: Column, args: dict, root: Column) -> Cell:
    exact = paths.as_text(source).try_cast("decimal(38,10)") / F.lit(100)
    return _cell("double", source, exact.cast("double"))


def _ms_to_s(source: Column, args: dict, root: Column) -> Cell:
    return _cell("double", source, to_double(source) / 1000)


TRANSFORMS: dict[str, Transform] = {
    "identity": Transform(_identity),
    "to_int": Transform(_to_int),
    "to_float": Transform(_to_float),
    "to_iso8601": Transform(_to_instant, _check_instant),
    "lower": Transform(_lower),
    "upper": Transform(_upper),
    "trim": Transform(_trim),
    "json_stringify": Transform(_json_stringify),
    "const": Transform(_const, lambda a: [] if "value" in a else ["`const` needs args.value"]),
    "coalesce": Transform(_coalesce, _check_coalesce),
    "map_enum": Transform(_map_enum, _check_map_enum),
    "split": Transform(_split, _check_split),
    "regex_extract": Transform(_regex_extract, _check_regex),
    "cents_to_usd": Transform(_cents_to_usd),
    "ms_to_s": Transform(_ms_to_s),
}


def apply(name: str, source: Column, args: dict | None = None, root: Column | None = None) -> Cell:
    """The cell of a named transform; ``root`` is the whole record, for ``coalesce``."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}")
    given = args or {}
    problems = TRANSFORMS[name].check(given)
    if problems:
        raise ValueError("; ".join(problems))
    return TRANSFORMS[name].build(source, given, source if root is None else root)
