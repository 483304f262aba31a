"""Arithmetic, rounding and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(c: Column) -> Column:
    return c / F.lit(1000.0)


def ratio(top: Column, bottom: Column) -> Column:
    """top/bottom, null where the bottom is zero."""
    return top / F.nullif(bottom, F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def half_away(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def change_or_zero(now: Column, before: Column) -> Column:
    """Percent change; 0 where there is no positive base."""
    return F.when(before > 0, (now - before) / before * 100.0).otherwise(F.lit(0.0))


def change_or_null(now: Column, before: Column) -> Column:
    return (now - before) / F.nullif(before, F.lit(0.0)) * 100.0


def index_of(now: Column, base: Column) -> Column:
    """now on a scale where base is 100."""
    return now / F.nullif(base, F.lit(0.0)) * 100.0


def at_least(c: Column, low: float) -> Column:
    """Lifts values below `low`; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def scaled(c: Column, low: Column, high: Column) -> Column:
    """Position between low and high; a flat range counts as width 1."""
    return (c - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def axis_pad(low: Column, high: Column) -> Column:
    """6 % of the span, or of max(1, high) where the span is empty."""
    return F.lit(0.06) * F.when(high > low, high - low).otherwise(F.greatest(F.lit(1.0), high))


def money(c: Column, digits: int = 0) -> Column:
    return F.coalesce(F.concat(F.lit("SGD "), F.format_number(c, digits)), F.lit("SGD —"))


def plain(c: Column, digits: int) -> Column:
    """A fixed number of digits, rounded on the exact value of the double, ties to even; no commas."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def signed_percent(c: Column) -> Column:
    shown = plain(c, 1)
    return F.concat(F.when(shown.startswith("-"), "").otherwise("+"), shown, F.lit("%"))


def fixed(c: Column, digits: int, missing: str = "N/A") -> Column:
    return F.coalesce(plain(c, digits), F.lit(missing))


def kilometres(c: Column) -> Column:
    return F.concat(plain(c, 2), F.lit(" km"))


def lenient_number(c: Column) -> Column:
    return c.try_cast("double")


def flag(c: Column) -> Column:
    return c.cast("double")
