import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import forecast
from hearthline.schema import forecast_shape


def month(i):
    return dt.date(2015 + i // 12, i % 12 + 1, 1)


RATES = "town string, flat_type string, month date, price_per_sqm double"
ASKED = "town string, flat_type string, floor_area_sqm double, horizon int"


def by_hand(points, area, horizon):
    """The forecast of one segment from its (month index, rate) points."""
    t = np.array([p[0] - points[0][0] for p in points], dtype=float)
    y = np.array([p[1] for p in points])
    slope, base = np.polyfit(t, y, 1)
    off = y - base - slope * t
    calendar = np.array([p[0] % 12 for p in points])
    season = {c: off[calendar == c].mean() for c in set(calendar)}
    rest = off - np.array([season[c] for c in calendar])
    spread = rest.std(ddof=1)
    steps = np.arange(1, horizon + 1)
    mean = np.array([base + slope * (t[-1] + h) + season.get((points[-1][0] + h) % 12, 0.0) for h in steps])
    factor = y[-1] / mean[0] if mean[0] > 0 else 1.0
    factor = factor if factor > 0 else 1.0
    bands = [mean, mean - forecast.Z95 * spread, mean + forecast.Z95 * spread]
    return [np.maximum(b * factor * area, 0.0) for b in bands]


def test_against_numpy_and_rejects(spark):
    rng = np.random.default_rng(2)
    segments = {
        "steady": [(i, 5000 + 20 * i + 100 * (i % 12) + rng.normal(0, 50)) for i in range(60)],
        "gaps": [(i, 4000 - 30 * i + rng.normal(0, 900)) for i in range(90) if i % 7],
        "falling": [(i, 3000.0 - 100 * i + rng.normal(0, 5)) for i in range(30)],
        "short": [(i, 1000.0) for i in range(23)],
    }
    rows = [(town, "A", month(i), float(y)) for town, points in segments.items() for i, y in points]
    asked = spark.createDataFrame([(t, "A", 80.0, 36) for t in [*segments, "unknown"]], ASKED)
    made = forecast.segment_forecast(spark.createDataFrame(rows, RATES), asked).collect()
    for town in ("steady", "gaps", "falling"):
        mine = sorted((r for r in made if r["town"] == town), key=lambda r: r["step"])
        wanted = by_hand(segments[town], 80.0, 36)
        for name, values in zip(("predicted_mean", "mean_ci_lower", "mean_ci_upper"), wanted):
            assert [r[name] for r in mine] == pytest.approx(list(values), rel=1e-8, abs=1e-6)
        assert [r["month"] for r in mine] == [month(segments[town][-1][0] + h) for h in range(1, 37)]
        assert all(r["mean_ci_lower"] <= r["predicted_mean"] <= r["mean_ci_upper"] for r in mine)
    assert min(r["mean_ci_lower"] for r in made if r["town"] == "falling") == 0.0
    rejected = {r["town"]: (r["status"], r["points"], r["step"], r["predicted_mean"]) for r in made if r["status"] != "ok"}
    assert rejected == {"short": ("too little history", 23, None, None), "unknown": ("too little history", 0, None, None)}


@pytest.mark.parametrize("last,following,factor", [(100.0, 50.0, 2.0), (100.0, 0.0, 1.0), (100.0, -5.0, 1.0), (0.0, 5.0, 1.0), (None, 5.0, 1.0)])
def test_calibration(spark, last, following, factor):
    column = forecast.calibration(F.lit(last).cast("double"), F.lit(following))
    assert spark.range(1).select(column.alias("v")).first()["v"] == factor


def test_series_and_headline(spark):
    rows = [("T", "A", month(i), 100.0) for i in range(40)]
    rates = spark.createDataFrame(rows, RATES)
    asked = spark.createDataFrame([("T", "A", 10.0, 3)], ASKED)
    history = rates.withColumn("price", F.col("price_per_sqm") * 10)
    ahead = forecast.segment_forecast(rates, asked)
    series = forecast.chart_series(history, ahead).orderBy("month").collect()
    assert [r["type"] for r in series] == ["Historical"] * 25 + ["Gap"] + ["Forecast"] * 3
    gap = series[25]
    assert (gap["month"], gap["price"], gap["ci_lower"]) == (month(39) + dt.timedelta(days=1), None, None)
    # Flat prices: padding is 6 % of the price.
    assert {(round(r["y_low"], 6), round(r["y_high"], 6)) for r in series} == {(940.0, 1060.0)}
    row = forecast.headline(rates, asked).first()
    assert (row["months"], row["forecast_text"], row["change_text"]) == (3, "SGD 1,000", "+0.0%")
    named = forecast.export_names(ahead, "forecast", "3m").first()["export_name"]
    assert named == "forecast_T_a_3m"


def test_two_requests_for_one_segment(spark):
    from hearthline.operators.segment import segment_history

    rates = spark.createDataFrame([("T", "A", month(i), 100.0) for i in range(30)], RATES)
    asked = spark.createDataFrame([(7, "T", "A", 10.0, 3), (8, "T", "A", 50.0, 4)], "request_id int, " + ASKED)
    history, ahead = segment_history(rates, asked), forecast.segment_forecast(rates, asked)
    rows = {r["request_id"]: (r["months"], round(r["last_price"]), round(r["forecast_price"])) for r in forecast.headline(rates, asked).collect()}
    assert rows == {7: (3, 1000, 1000), 8: (4, 5000, 5000)}
    counts = {r["request_id"]: r["count"] for r in forecast.chart_series(history, ahead).groupBy("request_id").count().collect()}
    assert counts == {7: 25 + 1 + 3, 8: 25 + 1 + 4}


def test_least_history_is_a_parameter(spark):
    rates = spark.createDataFrame([("T", "A", month(i), 100.0) for i in range(23)], RATES)
    asked = spark.createDataFrame([("T", "A", 10.0, 3)], ASKED)
    assert [r["status"] for r in forecast.segment_forecast(rates, asked).collect()] == ["too little history"]
    assert [r["status"] for r in forecast.segment_forecast(rates, asked, least_points=12).collect()] == ["ok"] * 3


def test_inputs(spark):
    facts = spark.createDataFrame(
        [("T", "4-room", 5, month(2), 1.0, 1.0), ("T", "4-room", 3, month(11), 1.0, 1.0), ("T", "9 room", 1, month(0), 1.0, 1.0)],
        "town string, flat_type string, district_number bigint, month date, resale_price double, floor_area_sqm double",
    )
    asked = spark.createDataFrame([("T", "4 ROOM", 80.0, 2), ("T", "9 ROOM", 80.0, 2)], ASKED)
    columns = ["district_number", "flat_type_4-ROOM", "other"]
    made = forecast.forecast_inputs(facts, asked, columns).orderBy("flat_type", "step").collect()
    assert [(r["step"], r["month"], r["district_number"], r["flat_type_4-ROOM"], r["other"]) for r in made[:2]] == [
        (1, dt.date(2016, 1, 1), 3.0, 1.0, 0.0),
        (2, dt.date(2016, 2, 1), 3.0, 1.0, 0.0),
    ]
    assert (made[2]["status"], made[2]["step"]) == ("no matching flat type", None) and len(made) == 3


def test_forecast_shape(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0)], "yhat double, lower double, mean_ci_upper double")
    assert forecast_shape(df).columns == ["mean", "mean_ci_lower", "mean_ci_upper"]
    with pytest.raises(ValueError, match="mean_ci_lower"):
        forecast_shape(df.drop("lower"))
