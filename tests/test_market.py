import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline.operators import market

SCHEMA = "month date, region string, flat_type string, resale_price double"


def sales(spark, *rows):
    return spark.createDataFrame(
        [(dt.date.fromisoformat(m + "-01"), r, f, p) for m, r, f, p in rows], SCHEMA
    )


def test_snapshot(spark):
    df = sales(
        spark,
        ("2017-05", "E", "A", 100.0),
        ("2017-06", "E", "A", 300.0),
        ("2020-01", "E", "A", 150.0),
        ("2020-02", "E", "A", 300.0),
        ("2020-02", "W", "B", 300.0),
        ("2020-02", None, None, 900.0),
    )
    row = market.kpi_snapshot(df).first()
    assert row["month"] == dt.date(2020, 2, 1) and row["month_name"] == "February 2020"
    assert (row["median_price"], row["prev_median_price"], row["median_price_change_pct"]) == (300.0, 150.0, 100.0)
    assert (row["transactions"], row["prev_transactions"], row["transactions_change_pct"]) == (3, 1, 200.0)
    assert (row["price_index"], row["index_vs_base_pct"]) == (150.0, 50.0)
    # Equal medians and equal counts: the first name wins.
    assert (row["top_region"], row["top_flat_type"], row["top_flat_type_share_pct"]) == ("E", "A", 50.0)


def test_snapshot_without_previous_month_or_base_year(spark):
    row = market.kpi_snapshot(sales(spark, ("2020-02", "E", "A", 300.0), ("2019-11", "E", "A", 100.0))).first()
    assert (row["prev_median_price"], row["prev_transactions"]) == (None, None)
    assert (row["median_price_change_pct"], row["transactions_change_pct"]) == (0.0, 0.0)
    assert (row["price_index"], row["index_vs_base_pct"]) == (None, None)


def test_snapshot_when_periods_overlap(spark):
    row = market.kpi_snapshot(sales(spark, ("2017-02", "E", "A", 300.0), ("2017-01", "E", "A", 100.0))).first()
    assert (row["median_price"], row["prev_median_price"], row["price_index"]) == (300.0, 100.0, 150.0)


def test_trend_keeps_a_null_group_and_the_range(spark):
    df = sales(
        spark, ("2020-01", None, "A", 1000.0), ("2020-01", "E", "A", 2000.0), ("2020-01", "E", "A", 4000.0), ("2020-03", "E", "A", 1.0)
    )
    made = market.trend(df, group_by="region", aggregate="median", end="2020-02-01").collect()
    assert [(r["region"], r["value"]) for r in made] == [(None, 1.0), ("E", 3.0)]
    assert [r["value"] for r in market.trend(df, aggregate="max").collect()] == [4.0, 0.001]


def test_trend_sets_tell_null_categories_from_the_whole(spark):
    df = sales(spark, ("2020-01", None, "A", 1000.0), ("2020-01", "E", "A", 3000.0))
    made = {(r["dimension"], r["category"]): r["median"] for r in market.trend_sets(df, dimensions=["region"]).collect()}
    assert made == {("all", None): 2.0, ("region", None): 1.0, ("region", "E"): 3.0}


def test_ranking_drops_null_categories(spark):
    df = sales(spark, ("2020-01", None, "A", 1.0), ("2020-01", "E", "A", 3.0), ("2020-01", "W", "B", 9.0), ("2020-01", "W", "B", 1.0))
    made = {r["category"]: r for r in market.ranking(df, dimensions=["region"]).collect()}
    assert set(made) == {"E", "W"}
    assert (made["W"]["mean_rank"], made["W"]["median_rank"], made["E"]["categories"]) == (1, 1, 2)


def test_composition(spark):
    df = sales(spark, *[("2020-01", "E", t, 1.0) for t in ("A", "A", "B", None)])
    assert [tuple(r) for r in market.composition(df).collect()] == [("A", 2, 66.7), ("B", 1, 33.3)]


def test_regression_edges(spark):
    df = spark.createDataFrame(
        [("E", 1.0, 3.0), ("E", 2.0, 5.0), ("W", 1.0, 7.0), ("S", 2.0, 1.0), ("S", 2.0, 3.0), (None, 9.0, 9.0), ("E", None, 1.0)],
        "region string, x double, y double",
    )
    made = {(r["dimension"], r["category"]): r for r in market.regression(df, "x", "y", ["region"]).collect()}
    east = made["region", "E"]
    assert (east["n"], east["slope"], east["intercept"], east["y_at_max"]) == (2, 2.0, 1.0, 5.0)
    assert made["region", "W"]["slope"] is None
    assert made["region", "S"]["slope"] is None
    assert made["all", None]["n"] == 6 and ("region", None) not in made


def test_map_extract_scales_the_extract(spark):
    rows = [
        (1.3, 103.8, 100000.0 * i, 1.0, "A", "M", 1.0, "s", "E", dt.date(2020, i, 1), 1, "m", 0.125, "s", None) for i in (1, 2, 3)
    ] + [(None, 103.8, 1.0, 1.0, "A", "M", 1.0, "s", "E", dt.date(2021, 1, 1), 1, "m", 1.0, "s", 1.0)]
    schema = (
        "latitude double, longitude double, resale_price double, price_per_sqm double, flat_type string, flat_model string, "
        "floor_area_sqm double, storey_range string, region string, month date, district_number bigint, nearest_mrt_name string, "
        "nearest_mrt_distance_km double, nearest_schools_name string, nearest_schools_distance_km double"
    )
    made = market.map_extract(spark.createDataFrame(rows, schema), limit=2).collect()
    assert sorted((r["month"], r["resale_price"], r["price_norm"]) for r in made) == [("Feb 2020", 200.0, 0.0), ("Mar 2020", 300.0, 1.0)]
    assert {r["nearest_mrt_distance_km"] for r in made} == {0.13}
    assert market.map_extract(spark.createDataFrame(rows[:1], schema)).first()["price_norm"] == 0.0


def test_heat_grid(spark):
    df = spark.createDataFrame(
        [(1.001, 103.001, 5.0), (1.002, 103.009, 7.0), (1.2, 103.0, 1.0), (None, 1.0, 1.0)],
        "latitude double, longitude double, resale_price double",
    )
    made = {(r["lat_cell"], r["lon_cell"]): (r["n"], r["weight"]) for r in market.heat_grid(df).collect()}
    assert made[100, 10300] == (2, 12.0) and len(made) == 2


def test_town_map_limit_and_centre(spark):
    from hearthline.schema import DISTANCES

    df = spark.range(30).select(
        F.lit("T").alias("town"),
        F.make_date(F.lit(2020), F.col("id").cast("int") % 12 + 1, F.lit(1)).alias("month"),
        (F.col("id") * 1000.0 + 500).alias("resale_price"),
        F.lit(2.5).alias("price_per_sqm"),
        F.lit("A").alias("flat_type"),
        F.lit(80.4).alias("floor_area_sqm"),
        F.lit(60.0).alias("remaining_lease"),
        F.col("id").cast("double").alias("latitude"),
        F.lit(1.0).alias("longitude"),
        *[F.lit(1.005).alias(d) for d in DISTANCES],
    )
    made = market.town_map(df, limit=4).collect()
    assert len(made) == 4 and {r["lease_text"] for r in made} == {"60.0 yrs"}
    assert {r["month_text"] for r in made} == {"Dec 2020", "Nov 2020"}
    assert {r["centre_latitude"] for r in made} == {sum(r["latitude"] for r in made) / 4}
    assert {r["price_per_sqm"] for r in made} == {2.0}


def test_missing_column_is_named_before_any_job(spark):
    with pytest.raises(ValueError, match="region"):
        market.kpi_snapshot(spark.createDataFrame([], "month date, resale_price double, flat_type string"))
