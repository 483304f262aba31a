from pyspark.sql import functions as F

from hearthline.functions.features import NUMERIC_FEATURES
from hearthline.operators import scoring


def test_prices_follow_the_sales(spark):
    sales = spark.range(400).select(
        *[F.lit(1.0).alias(c) for c in NUMERIC_FEATURES if c != "remaining_lease"],
        (F.col("id") % 100).cast("double").alias("remaining_lease"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("flat_type"),
        F.when(F.col("id") % 2 == 0, 100.0).otherwise(900.0).alias("price_per_sqm"),
        F.lit("E").alias("region"),
    )
    columns = (["flat_type_A", "flat_type_B"], ["region_East"], F.lit("region_East"))
    model = scoring.train(sales, *columns, trees=5, depth=3)
    asked = spark.createDataFrame([("a", 10.0, 50.0), ("b", 20.0, 51.0)], "flat_type string, floor_area_sqm double, remaining_lease double")
    made = {r["flat_type"]: r for r in scoring.score(asked, model, *columns, keep=["flat_type"]).collect()}
    assert made["a"]["predicted_rate"] < made["b"]["predicted_rate"]
    assert made["b"]["predicted_price"] == made["b"]["predicted_rate"] * 20.0
    again = scoring.train(sales, *columns, trees=5, depth=3)
    repeated = {r["flat_type"]: r for r in scoring.score(asked, again, *columns, keep=["flat_type"]).collect()}
    assert repeated == made
    nothing = scoring.score(asked, None, *columns, keep=["flat_type"]).collect()
    assert {r["predicted_price"] for r in nothing} == {None}


def test_a_seed_is_one_forest_for_any_layout(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PART_ROWS", 150)
    rows = spark.range(700).select(
        *[((F.col("id") * (3 + i)) % 17).cast("double").alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("flat_type"),
        (F.col("id") % 23 * 10.0 + F.rand(5)).alias("price_per_sqm"),
        F.lit("E").alias("region"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    columns = (["flat_type_A", "flat_type_B"], ["region_East"], F.lit("region_East"))
    asked = rows.select("flat_type", *NUMERIC_FEATURES).limit(50)

    def rates(parts):
        model = scoring.train(rows.repartition(parts, F.rand(parts)), *columns, trees=6, depth=5)
        return sorted(r["predicted_rate"] for r in scoring.score(asked, model, *columns, keep=["flat_type"]).collect())

    assert rates(3) == rates(11)
