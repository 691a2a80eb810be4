"""Scalar rules shared by every measure: NULL is not zero, errors, durations, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.schemas import ERROR_STATUSES


def is_error(status: Column) -> Column:
    return F.coalesce(status.isin(*ERROR_STATUSES), F.lit(False))


def error_count(status: Column) -> Column:
    return F.sum(is_error(status).cast("long"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Real division that is NULL on a NULL or zero denominator."""
    return F.try_divide(numerator.cast("double"), F.nullif(denominator.cast("double"), F.lit(0.0)))


def duration_ms_rounded(start: Column, end: Column) -> Column:
    """Milliseconds between two instants, half rounded up; NULL when a bound is missing."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)).cast("long")


def duration_ms_truncated(start: Column, end: Column) -> Column:
    """Whole milliseconds between two instants, as shown on a session detail."""
    return F.timestamp_diff("MILLISECOND", start, end)


def total_tokens(prompt: Column, completion: Column) -> Column:
    """Sum of the present parts, NULL only when both are absent."""
    zero = F.lit(0).cast("long")
    return F.when(
        prompt.isNotNull() | completion.isNotNull(),
        F.coalesce(prompt, zero) + F.coalesce(completion, zero),
    )


def estimated_cost(
    prompt: Column,
    completion: Column,
    cached: Column,
    input_price: Column,
    output_price: Column,
    cached_price: Column,
) -> Column:
    """USD from prices per million tokens; NULL when the model has no price.

    Cached tokens are part of the prompt and are billed at both prices, and a priced call
    without tokens costs 0.0. Both follow from the cost definition this library matches.
    """

    def part(tokens: Column, price: Column) -> Column:
        return F.coalesce(tokens, F.lit(0).cast("long")) * price

    free = F.coalesce(cached_price, F.lit(0.0))
    total = part(prompt, input_price) + part(completion, output_price) + part(cached, free)
    return total / F.lit(1_000_000.0)


def utc_day(moment: Column) -> Column:
    return F.to_date(moment)


def sha1_mod(key: Column, modulo: int) -> Column:
    """``sha1(key)`` read as a 160-bit integer, modulo ``modulo``, in native arithmetic.

    Ten 16-bit digits are folded from the left; each step stays below 2**47.
    """
    if not 1 <= modulo < 2**31:
        raise ValueError("modulo must be in [1, 2**31)")
    digest = F.sha1(key)
    remainder = F.lit(0).cast("long")
    for digit in range(10):
        chunk = F.conv(F.substring(digest, 4 * digit + 1, 4), 16, 10).cast("long")
        remainder = (remainder * F.lit(65536) + chunk) % F.lit(modulo)
    return remainder
