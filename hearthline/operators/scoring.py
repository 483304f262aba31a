"""Price scoring: a random forest learns the price per sqm and prices requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import features

# Rows of a part that trees draw their samples from, about.
PART_ROWS = 100_000


def train(
    sales: DataFrame,
    flat_columns: Sequence[str],
    region_columns: Sequence[str],
    region: Column,
    trees: int = 20,
    depth: int = 6,
    seed: int = 7,
) -> PipelineModel:
    """Fits price_per_sqm on the request features; rows lacking the price or a number are left out.

    Which rows a tree sees depends on how the rows are dealt out. They are dealt by their content, into as many parts as their
    number asks for, and sorted in each, so a seed means one forest for the same rows, whatever the cluster and the layout.
    """
    complete = sales.na.drop(subset=["price_per_sqm", *[c for c in features.NUMERIC_FEATURES if c in sales.columns]])
    rows = features.request_features(complete, flat_columns, region_columns, region, keep=["price_per_sqm"])
    wanted = [*features.NUMERIC_FEATURES, *flat_columns, *region_columns]
    rows = dealt_by_content(rows.select("price_per_sqm", *wanted))
    stages = [
        VectorAssembler(inputCols=wanted, outputCol="features"),
        RandomForestRegressor(
            labelCol="price_per_sqm", predictionCol="predicted_rate", numTrees=trees, maxDepth=depth, seed=seed
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def dealt_by_content(rows: DataFrame) -> DataFrame:
    """The rows in parts and an order that depend on nothing but their values."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    content = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    given = [F.col(f"`{c}`") for c in rows.columns]
    return rows.withColumn("_content", content).repartition(parts, "_content").sortWithinPartitions("_content", *given).drop("_content")


def score(
    requests: DataFrame,
    model: PipelineModel | None,
    flat_columns: Sequence[str],
    region_columns: Sequence[str],
    region: Column,
    keep: Sequence[str],
) -> DataFrame:
    """keep, floor_area_sqm, predicted_rate, predicted_price; the prediction is null without a model."""
    rows = features.request_features(requests, flat_columns, region_columns, region, keep=keep)
    if model is None:
        rated = rows.withColumn("predicted_rate", F.lit(None).cast("double"))
    else:
        wanted = model.stages[0].getInputCols()
        rated = model.transform(features.aligned(rows, wanted, keep=keep))
    return rated.select(
        *keep,
        "floor_area_sqm",
        "predicted_rate",
        (F.col("predicted_rate") * F.col("floor_area_sqm")).alias("predicted_price"),
    )
