"""Masking of e-mail addresses, secrets and home-directory paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The four masked families, applied in this order, and their placeholder.
PLACEHOLDER = "[REDACTED]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PROVIDER_KEY = r"(?i)\b(?:bearer\s+)?(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{12,})\b"
ASSIGNED_SECRET = (
    r"(?i)\b(?:api[_ -]?key|access[_ -]?token|secret|password)\s*[:=]\s*[^\s,;]+"
)
HOME_DIRECTORY = r"(?:[A-Za-z]:\\Users\\[^\\\s]+|/home/[^/\s]+|/Users/[^/\s]+)"
FAMILIES = (EMAIL, PROVIDER_KEY, ASSIGNED_SECRET, HOME_DIRECTORY)


def _unicode(pattern: str) -> str:
    """The pattern with blanks, words and cases of all scripts, as its source means it.

    The separators 0x1c to 0x1f are blanks there too.
    """
    inside = pattern.replace(r"[^\s,;]", r"[^\s\x1c-\x1f,;]").replace(
        r"[^\\\s]", r"[^\\\s\x1c-\x1f]"
    ).replace(r"[^/\s]", r"[^/\s\x1c-\x1f]")
    return "(?U)" + inside.replace(r"\s*", r"[\s\x1c-\x1f]*").replace(r"\s+", r"[\s\x1c-\x1f]+")


def _worth_trying(text: Column) -> list[Column]:
    """Per family, a plain substring test that every match must pass.

    The placeholder holds none of these substrings, so the tests on the original text stay
    valid after earlier families were replaced.
    """
    lower = F.lower(text)

    def any_of(haystack: Column, *needles: str) -> Column:
        found = haystack.contains(needles[0])
        for needle in needles[1:]:
            found = found | haystack.contains(needle)
        return found

    return [
        text.contains("@"),
        any_of(lower, "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        any_of(lower, "key", "token", "secret", "password") & any_of(text, ":", "="),
        any_of(text, "/home/", "Users"),
    ]


def redact(text: Column) -> Column:
    """One string column with every sensitive span replaced."""
    clean = text
    for pattern, needed in zip(FAMILIES, _worth_trying(text)):
        replaced = F.regexp_replace(clean, F.lit(_unicode(pattern)), F.lit(PLACEHOLDER))
        clean = F.when(needed, replaced).otherwise(clean)
    return clean


def _redact_typed(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return redact(value)
    if isinstance(dtype, T.ArrayType) and _holds_text(dtype):
        return F.transform(value, lambda item: _redact_typed(item, dtype.elementType))
    if isinstance(dtype, T.MapType) and _holds_text(dtype.valueType):
        return F.transform_values(value, lambda _, item: _redact_typed(item, dtype.valueType))
    if isinstance(dtype, T.StructType) and _holds_text(dtype):
        fields = [_redact_typed(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_text(f.dataType) for f in dtype.fields)
    return False


def redact_columns(df: DataFrame, *names: str) -> DataFrame:
    """Redact string leaves (values, never keys) of the named columns, at any depth."""
    chosen = names or tuple(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({n: _redact_typed(F.col(n), types[n]) for n in chosen})


# Raw control characters cannot occur in JSON text, so they can stand in for its escapes.
_BACKSLASH, _QUOTE = "\u0002", "\u0001"


def redact_json(json_text: Column) -> Column:
    """JSON text with every string value redacted; keys, numbers and structure are kept.

    Text that holds nothing to redact is passed on as it is, and strings without escapes are
    not decoded.
    """
    marked = F.replace(json_text, F.lit("\\\\"), F.lit(_BACKSLASH))
    marked = F.replace(marked, F.lit('\\"'), F.lit(_QUOTE))
    tokens = F.regexp_extract_all(marked, F.lit('"[^"]*":?|[^"]+'), F.lit(0))

    def decoded(token: Column) -> Column:
        listed = F.concat(F.lit("["), _unmarked(token), F.lit("]"))
        text = F.element_at(F.from_json(listed, T.ArrayType(T.StringType())), 1)
        quoted = F.to_json(F.array(redact(text)))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    def clean(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        plain = F.concat(F.lit('"'), redact(inner), F.lit('"'))
        is_value = token.startswith('"') & ~token.endswith(":")
        escaped = token.rlike(f"[\\\\{_BACKSLASH}{_QUOTE}]")
        return (
            F.when(is_value & escaped, decoded(token))
            .when(is_value, plain)
            .otherwise(_unmarked(token))
        )

    worth = json_text.contains("\\u")
    for needed in _worth_trying(json_text):
        worth = worth | needed
    redacted = F.array_join(F.transform(tokens, clean), "")
    return F.when(worth, redacted).otherwise(json_text)


def _unmarked(text: Column) -> Column:
    quoted = F.replace(text, F.lit(_QUOTE), F.lit('\\"'))
    return F.replace(quoted, F.lit(_BACKSLASH), F.lit("\\\\"))
