"""Vector arithmetic over array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; elements are null for a zero vector.

    The one-element outer array binds the length once instead of once per element.
    """
    measured = F.array(F.struct(a.alias("v"), length(a).alias("n")))
    return F.transform(
        measured,
        lambda m: F.transform(m["v"], lambda x: x.cast("double") / F.nullif(m["n"], F.lit(0.0))),
    )[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(length(a) * length(b), F.lit(0.0))
