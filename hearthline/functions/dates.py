"""Dates and month arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(c: Column) -> Column:
    return F.to_date(c)


def lenient_date(c: Column) -> Column:
    return F.try_to_date(c)


def month_start(c: Column) -> Column:
    return F.to_date(F.date_trunc("month", c))


def month_number(c: Column) -> Column:
    """Months on one running count, so that differences are whole months."""
    return F.year(c) * 12 + F.month(c)


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMM yyyy")


def long_month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM yyyy")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def steps_ahead(n: Column) -> Column:
    """1..n; explode to get one row per future step."""
    return F.sequence(F.lit(1), n)
