"""Positions and first rows that hold up when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.operators.distribution import attach

# Rows of a chunk, about, and into how many parts the order, or a part of it, is cut in one pass.
CHUNK_ROWS = 1 << 20
PARTS = 1000

Chunker = Callable[[DataFrame], DataFrame]


def _bucketed(cuts: list[float]) -> Callable[[DataFrame], DataFrame]:
    """What adds `_bucket`, the place of `_order` among the cuts."""
    if not cuts:
        return lambda rows: rows.withColumn("_bucket", F.lit(0.0))
    return Bucketizer(splits=[-inf, *cuts, inf], inputCol="_order", outputCol="_bucket", handleInvalid="keep").transform


def quantile_cuts(orders: DataFrame, count: int) -> list[float]:
    """Where to cut `_order` so that about equally many values lie between cuts: `count` parts, or fewer if values are equal.

    A pass cuts every part it knows into at most PARTS; each takes a few numbers per cut, combined before its shuffle.
    """
    first = min(count, PARTS)
    if first <= 1:
        return []
    cuts = sorted(set(orders.approxQuantile("_order", [i / first for i in range(1, first)], 1 / (4 * first))))
    made = first
    while made < count:
        more = min(PARTS, -(-count // made))
        inner = F.percentile_approx("_order", [i / more for i in range(1, more)], 4 * more).alias("inner")
        parts = _bucketed(cuts)(orders).groupBy("_bucket").agg(inner).collect()
        cuts = sorted({*cuts, *(c for part in parts for c in part["inner"])})
        made *= more
    return cuts


def chunks(df: DataFrame, order: str) -> Chunker:
    """What adds `_chunk` to rows: which part of the order they are in.

    The cuts are quantiles of the order, found by passes over that column alone, so chunks are alike in size
    whether the values are dense, sparse or hashed. Equal values share a chunk.
    """
    column = df.select(F.col(order).cast("double").alias("_order")).where("_order IS NOT NULL")
    cuts = quantile_cuts(column, -(-column.count() // CHUNK_ROWS))
    if not cuts:
        # Not a literal: a join on the chunk stays one on a column.
        return lambda rows: rows.withColumn("_chunk", F.coalesce(F.pmod(F.col(order).cast("bigint"), F.lit(1)), F.lit(0)).cast("int"))
    place = _bucketed(cuts)
    return lambda rows: (
        place(rows.withColumn("_order", F.col(order).cast("double")))
        .withColumn("_chunk", F.col("_bucket").cast("int"))
        .drop("_order", "_bucket")
    )


def by_chunk(df: DataFrame, keys: Sequence[str], cut: Chunker, partials: dict[str, Column]) -> DataFrame:
    """Aggregates per (keys, chunk), combined before the shuffle; the stepping stone to group figures."""
    return cut(df).groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in partials.items()])


def to_chunk(df: DataFrame, figures: DataFrame, keys: Sequence[str], cut: Chunker, null_keys: bool = False) -> DataFrame:
    """Joins per-chunk figures back to rows. The chunk in the key spreads a hot group over many tasks."""
    return attach(cut(df), figures, [*keys, "_chunk"], null_keys)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    total: str | None = None,
    first: str | None = None,
    null_keys: bool = False,
) -> DataFrame:
    """Adds each row's place, from 1, among its group by `order`, a whole number unique in the group.

    The cuts of the order are found when this is called. `total` and `first` name further columns: the rows of the group and its lowest `order`.
    Rows with a null key are a group with null_keys, which costs one more shuffle, and
    are left out otherwise.
    """
    keys = list(keys)
    cut = chunks(df, order)
    sizes = by_chunk(df, keys, cut, {"_rows": F.count(F.lit(1)), "_first": F.min(order)})
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    figures = {"_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))}
    if total:
        figures[total] = F.sum("_rows").over(group)
    if first:
        figures[first] = F.min("_first").over(group)
    offsets = sizes.select(*keys, "_chunk", *[c.alias(n) for n, c in figures.items()])
    inside = W.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        to_chunk(df, offsets, keys, cut, null_keys)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_chunk", "_offset")
    )


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank", parts: int = 128
) -> DataFrame:
    """The first k rows per group under a total order, numbered from 1.

    For k up to 1000 Spark drops all but k rows per group and map task before a shuffle
    (spark.sql.optimizer.windowGroupLimitThreshold); use newest_rows for more. The first
    round works on parts of a group, so the last one meets at most parts * k rows
    however many map tasks fed it. Which rows share a part does not affect the result.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    round_one = W.partitionBy(*keys, "_part").orderBy(*order)
    round_two = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_r", F.row_number().over(round_one))
        .where(F.col("_r") <= k)
        .drop("_part", "_r")
        .withColumn(name, F.row_number().over(round_two).cast("bigint"))
        .where(F.col(name) <= k)
    )


def newest_rows(df: DataFrame, n: int, day: str, scatter: Sequence[Column]) -> DataFrame:
    """n rows, newest `day` first; within the last day admitted, the lowest hash of `scatter` goes first.

    Two counting passes find the cut, so only about n rows reach the final sort: first
    the day in which row n falls, then the hash cell within that day. `scatter` should
    tell rows apart as far as possible; rows equal in all columns are counted.
    """
    cell = F.substring(F.md5(F.concat_ws("|", *scatter)), 1, 4)
    days = df.where(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    newer = W.orderBy(F.desc(day)).rowsBetween(W.unboundedPreceding, -1)
    reached = days.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_before") < n)
    last_day = reached.agg(F.min(day)).scalar()
    room = F.lit(n) - reached.agg(F.max("_before")).scalar()

    recent = df.where(F.col(day) >= last_day).withColumn("_hash", F.md5(F.concat_ws("|", *scatter)))
    cells = recent.where(F.col(day) == last_day).groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    lower = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    admitted = cells.withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0))).where(
        F.col("_before") < room
    )
    last_cell = admitted.agg(F.max("_cell")).scalar()
    kept = recent.where((F.col(day) > last_day) | (F.substring("_hash", 1, 4) <= last_cell))
    # Equal rows are counted, so that any number of copies is one row on the way to the final sort.
    order = [F.desc(day), F.col("_hash"), *[F.col(c).asc_nulls_last() for c in df.columns if c != day]]
    first = kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("_copies")).orderBy(*order).limit(n)
    # At most n rows: one window over them is one small task.
    ahead = F.coalesce(F.sum("_copies").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shown = first.withColumn("_take", F.least(F.col("_copies"), F.lit(n) - ahead)).where(F.col("_take") > 0)
    return shown.select(*df.columns, F.explode(F.sequence(F.lit(1), "_take")).alias("_copy")).drop("_copy")
