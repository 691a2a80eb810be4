"""Dotted-path access into VARIANT payloads, and filters on it."""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(value: Column) -> Column:
    """An explicit JSON null counts as absent."""
    return F.when(~F.is_variant_null(value), value)


def _key(name: str) -> str:
    if "'" not in name:
        return f"$['{name}']"
    if '"' not in name:
        return f'$["{name}"]'
    raise ValueError(f"a path segment cannot hold both quote characters: {name!r}")


def _step(value: Column, segment: str) -> Column:
    """One segment: a key on an object; on a list an index, counted from the end if negative."""
    by_key = F.try_variant_get(value, _key(segment), "variant")
    try:
        index = int(segment)
    except ValueError:
        return by_key
    if index >= 0:
        by_index = F.try_variant_get(value, f"$[{index}]", "variant")
    else:
        items = F.try_variant_get(value, "$", "array<variant>")
        by_index = F.try_element_at(items, F.lit(index))
    # An object has no index and a list no key, so at most one side is present.
    return F.coalesce(by_index, by_key)


def field(payload: Column, name: str) -> Column:
    """A top-level key, taken literally (dots included)."""
    return _present(F.try_variant_get(payload, _key(name), "variant"))


def path(payload: Column, dotted: str) -> Column:
    """The value at ``a.b.0.c``, NULL when absent, out of range, or an explicit null."""
    segments = dotted.split(".")
    simple = not any(_is_int(s) or "'" in s for s in segments)
    if simple:
        joined = "$" + "".join(f"['{s}']" for s in segments)
        return _present(F.try_variant_get(payload, joined, "variant"))
    value = payload
    for segment in segments:
        value = _step(value, segment)
    return _present(value)


def _is_int(segment: str) -> bool:
    try:
        int(segment)
    except ValueError:
        return False
    return True


def lookup(row: Column | None, root: Column, dotted: str) -> Column:
    """The value in the iterated row, else in the whole record."""
    return path(root, dotted) if row is None else F.coalesce(path(row, dotted), path(root, dotted))


def rows_at(payload: Column, dotted: str) -> Column:
    """``ARRAY<VARIANT>`` of the list at a path; NULL when it is not a list."""
    return F.try_variant_get(path(payload, dotted), "$", "array<variant>")


def kind(value: Column) -> Column:
    """Leading type name: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, OBJECT, ARRAY, VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def as_text(value: Column) -> Column:
    """The text a value has in keys and ids: ``True``, ``7``, ``1.0``, strings as they are."""
    schema = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    whole_float = schema.rlike(r"^DECIMAL\((?:[1-9]|1[0-8]),0\)$")
    return (
        F.when(schema == "BOOLEAN", F.initcap(plain))
        .when(whole_float, F.concat(plain, F.lit(".0")))
        .otherwise(plain)
    )


def matches(row: Column, name: str, op: str, expected: Any) -> Column:
    """One filter on the row itself; it never looks at the enclosing record."""
    actual = path(row, name)
    if op == "eq":
        return _equals(actual, expected)
    if op == "ne":
        return ~_equals(actual, expected)
    if op == "in":
        if not isinstance(expected, (list, tuple)):
            return F.lit(False)
        hit = F.lit(False)
        for item in expected:
            hit = hit | _equals(actual, item)
        return hit
    if op == "exists":
        return actual.isNotNull() if expected else actual.isNull()
    if op in ("gt", "lt"):
        return _compares(actual, op, expected)
    raise ValueError(f"unknown filter operator {op!r}")


def _equals(actual: Column, expected: Any) -> Column:
    """Numbers and booleans compare by value, everything else by its JSON form."""
    if expected is None:
        return actual.isNull()
    if isinstance(expected, str):
        text = F.when(is_text(actual), F.try_variant_get(actual, "$", "string"))
        return F.coalesce(text == F.lit(expected), F.lit(False))
    if isinstance(expected, (bool, int, float)):
        return F.coalesce(_by_number(actual, expected, lambda a, b: a == b), F.lit(False))
    wanted = F.to_json(F.parse_json(F.lit(json.dumps(expected))))
    return F.coalesce(F.to_json(actual) == wanted, F.lit(False))


def _by_number(actual: Column, expected: Any, compare: Callable) -> Column:
    """``compare(number, expected)``; whole numbers of any size are compared exactly."""
    inexact = compare(
        F.when(~is_text(actual), F.try_variant_get(actual, "$", "double")), F.lit(float(expected))
    )
    if isinstance(expected, float) or abs(expected) >= 10**38:
        return inexact
    whole = F.schema_of_variant(actual).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$")
    exact = F.try_variant_get(actual, "$", "decimal(38,0)")
    return F.when(whole, compare(exact, F.lit(Decimal(int(expected))))).otherwise(inexact)


def _compares(actual: Column, op: str, expected: Any) -> Column:
    """Order comparison of like with like; other types never match."""
    if isinstance(expected, str):
        value = F.when(is_text(actual), F.try_variant_get(actual, "$", "string"))
        bound = F.lit(expected)
    elif isinstance(expected, (bool, int, float)):
        order = (lambda a, b: a > b) if op == "gt" else (lambda a, b: a < b)
        return F.coalesce(_by_number(actual, expected, order), F.lit(False))
    else:
        return F.lit(False)
    return F.coalesce(value > bound if op == "gt" else value < bound, F.lit(False))
