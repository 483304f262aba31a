"""Exact medians, quantiles and histograms of groups of any size.

A built-in exact percentile keeps every distinct value of a group in one task, which a
group holding a third of a large table does not allow. Here a group is cut into slices
of equal width on a log scale. A first pass counts per (group, slice), combined before
its shuffle, and finds the slices in which the wanted ranks fall. That small table is
stored; a last pass keeps only the rows of those slices and ranks their distinct values.
If a slice found is itself too large for one task, passes in between cut it into cells
and go on with the cells found. The planner broadcasts the stored table if its size allows,
and joins on (group, slice) otherwise, so a hot group is spread over its slices either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.runtime import durable

SLICES_PER_E_FOLD = 256
# A cell with more rows, unless all hold one value, is cut further before its values are ranked.
LARGEST_CELL = 1_000_000
CELLS = 4096
# Below every real slice: the place of null values, which have no rank.
NULL_SLICE = -(2**40)


def value_slice(v: Column) -> Column:
    """A whole number that never falls as v rises."""
    folded = F.signum(v) * F.log1p(F.abs(v))
    bounded = F.greatest(F.least(folded, F.lit(710.0)), F.lit(-710.0))
    return F.coalesce(F.floor(bounded * SLICES_PER_E_FOLD), F.lit(NULL_SLICE))


def sliced(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, _v, _slice, _w: how often the value counts. NaN is null, and null counts 0 times."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    times = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.select(*keys, v.alias("_v"), times.alias("_w"))
    return rows.withColumns(
        {"_slice": value_slice(F.col("_v")), "_w": F.when(F.col("_v").isNotNull(), F.col("_w")).otherwise(0)}
    )


# What a slice or cell carries: rows in it, and how often they count, what counts in its group below it, its ends, its
# group's figures.
FIGURES = ["_rows", "_sn", "_before", "_lo", "_hi", "n", "mean", "min", "max"]


def slice_figures(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _slice and FIGURES of every slice."""
    slices = rows.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_w").alias("_sn"),
        F.sum(F.col("_v") * F.col("_w")).alias("_sum"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("_sn").over(group)
    return slices.select(
        *keys,
        "_slice",
        "_rows",
        "_sn",
        F.coalesce(F.sum("_sn").over(earlier), F.lit(0)).alias("_before"),
        "_lo",
        "_hi",
        total.alias("n"),
        (F.sum("_sum").over(group) / F.nullif(total, F.lit(0))).alias("mean"),
        F.min("_lo").over(group).alias("min"),
        F.max("_hi").over(group).alias("max"),
    )


def cell_figures(rows: DataFrame, keys: Sequence[str], cells: Sequence[str], new: str) -> DataFrame:
    """keys, cells, the new cell and FIGURES, from rows that carry the figures of the cell around."""
    carried = {c: F.max(c).alias(c) for c in ("_before", "n", "mean", "min", "max")}
    found = rows.groupBy(*keys, *cells, new).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_w").alias("_sn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *carried.values()
    )
    lower = W.partitionBy(*keys, *cells).orderBy(new).rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_sn").over(lower), F.lit(0)))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys: bool = False) -> DataFrame:
    """Inner join on keys; with null_keys two nulls are the same key."""
    if not null_keys:
        return left.join(right, list(keys))
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    null_keys: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """keys, n, mean, min, max and one exact, linearly interpolated quantile per entry.

    `quantiles` maps a column name to a probability. A group without values keeps its
    row, with n = 0. Without null_keys, rows with a null key are left out. `weight` names
    a column that says how often a row counts. The first pass, and further ones where a slice
    holds more than LARGEST_CELL rows, run when this is called.
    """
    keys = list(keys)
    if not null_keys and keys:
        df = df.na.drop(subset=keys)
    rows = sliced(df, keys, value, weight)

    def place(p: float) -> Column:
        return F.lit(float(p)) * (F.col("n") - 1).cast("double")

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_sn"))

    wanted = F.col("n") == 0
    for p in quantiles.values():
        wanted = wanted | holds(F.floor(place(p))) | holds(F.ceil(place(p)))
    cells = ["_slice"]
    hit = durable(slice_figures(rows, keys).where(wanted))
    while not hit.where((F.col("_rows") > LARGEST_CELL) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        new = f"_cell{len(cells)}"
        width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        cut = F.floor((F.col("_v") - F.col("_lo")) / width * CELLS)
        inside = attach(rows, hit, [*keys, *cells], null_keys).withColumn(
            new, F.coalesce(F.least(cut, F.lit(CELLS - 1)), F.lit(0))
        )
        hit = durable(cell_figures(inside, keys, cells, new).where(wanted))
        rows = inside.drop(*FIGURES)
        cells.append(new)
    figures = ["_before", "n", "mean", "min", "max"]
    near = attach(rows, hit.drop("_rows", "_sn", "_lo", "_hi"), [*keys, *cells], null_keys)
    # The figures are the same on all rows of a slice.
    counts = near.groupBy(*keys, *cells, "_v").agg(
        F.sum("_w").alias("_n"), *[F.max(c).alias(c) for c in figures]
    )
    if keys:
        # A group is down to the distinct values of a few slices: one exchange serves ranking and picking.
        counts = counts.repartition(*keys)
    up_to_here = W.partitionBy(*keys, *cells).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_end", F.col("_before") + F.sum("_n").over(up_to_here)).withColumn(
        "_start", F.col("_end") - F.col("_n")
    )

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "mean", "min", "max")],
        *[
            F.struct(value_at(F.floor(place(p))).alias("low"), value_at(F.ceil(place(p))).alias("high")).alias(name)
            for name, p in quantiles.items()
        ],
    )
    return picked.select(
        *keys,
        "n",
        "mean",
        "min",
        "max",
        *[
            (
                F.col(name)["low"]
                + (F.col(name)["high"] - F.col(name)["low"]) * (place(p) - F.floor(place(p)))
            ).alias(name)
            for name, p in quantiles.items()
        ],
    )


def nice_step(low: Column, high: Column, most_bins: int) -> Column:
    """The chart library's bin width: a power of ten, cut by 5 and by 2 while the bins still fit."""
    span = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.nullif(F.abs(low), F.lit(0.0)), F.lit(1.0))
    level = len(str(most_bins - 1))
    step = F.pow(F.lit(10.0), F.round(F.log10(span)) - F.lit(level))
    step = F.when(F.ceil(span / step) > most_bins, step * 10.0).otherwise(step)
    for part in (5.0, 2.0):
        step = F.when(span / (step / part) <= most_bins, step / part).otherwise(step)
    return step


def nice_start(low: Column, step: Column) -> Column:
    """The lower edge of the first bin."""
    digits = F.when(step >= 1.0, F.lit(0.0)).otherwise(F.floor(-F.log10(step)) + 1.0)
    edge = F.floor(low / step + F.pow(F.lit(10.0), -digits - 1.0)) * step
    return F.when(low < edge, edge - step).otherwise(edge)


def histogram(df: DataFrame, keys: Sequence[str], value: str, most_bins: int = 35) -> DataFrame:
    """keys, bin, bin_start, bin_end, n and the group's total, with chart-style bin edges per group.

    The first pass, for each group's range, runs when this is called.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).na.drop()
    ranges = rows.groupBy(*keys).agg(F.min("_v").alias("min"), F.max("_v").alias("max"), F.count("_v").alias("total"))
    edges = (
        ranges.withColumn("step", nice_step(F.col("min"), F.col("max"), most_bins))
        .withColumn("start", nice_start(F.col("min"), F.col("step")))
        .withColumn("stop", F.ceil(F.col("max") / F.col("step")) * F.col("step"))
        .withColumn("last", F.greatest(F.col("stop") - F.col("step"), F.col("start")))
        .drop("min", "max", "stop")
    )
    # A value on the outer edge belongs to the last bin; 1e-14 is the chart library's rounding slack.
    inside = F.least(F.col("_v"), F.col("last"))
    binned = attach(rows, durable(edges), keys).withColumn(
        "bin", F.floor((inside - F.col("start")) / F.col("step") + 1e-14)
    )
    return (
        binned.groupBy(*keys, "bin")
        .agg(
            F.max("start").alias("start"),
            F.max("step").alias("step"),
            F.max("total").alias("total"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            *keys,
            "bin",
            (F.col("start") + F.col("bin") * F.col("step")).alias("bin_start"),
            (F.col("start") + (F.col("bin") + 1) * F.col("step")).alias("bin_end"),
            "n",
            "total",
        )
    )
