import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators import segment
from hearthline.schema import DISTANCES


def test_size_bounds_with_fallbacks(spark):
    rows = [("T1", "4-room", float(a)) for a in range(80, 101)] + [("T2", "3 ROOM", 60.0), ("T2", "3-room", 60.0), (None, "3 ROOM", 10.0)]
    df = spark.createDataFrame(rows, "town string, flat_type string, floor_area_sqm double")
    made = {(r["town"], r["flat_type"]): tuple(r[2:]) for r in segment.size_bounds(df).collect()}
    assert made["T1", "4 ROOM"] == (81.0, 99.0, 90.0)
    assert made["T2", "3 ROOM"] == (60.0, 61.0, 60.0)
    # No sale of this kind: bounds of the market (24 sizes), default size 80.
    assert set(made) == {("T1", "4 ROOM"), ("T2", "3 ROOM"), ("T1", "3 ROOM"), ("T2", "4 ROOM")}
    assert made["T1", "3 ROOM"] == made["T2", "4 ROOM"] == (60.0, 99.0, 80.0)


def test_size_bounds_without_any_size(spark):
    df = spark.createDataFrame([("T", "A", None)], "town string, flat_type string, floor_area_sqm double")
    assert [tuple(r) for r in segment.size_bounds(df).collect()] == [("T", "A", 20.0, 200.0, 80.0)]


def test_usual_district(spark):
    df = spark.createDataFrame(
        [("T", 7), ("T", 3), ("T", 7), ("T", 3), ("T", None), ("T", None), ("T", None), ("U", None)],
        "town string, district_number bigint",
    )
    made = {r["town"]: r["district_number"] for r in segment.usual_district(df).collect()}
    assert made == {"T": 3.0, "U": 0.0}


def test_monthly_rates_leave_out_zero_areas(spark):
    m = dt.date(2020, 1, 1)
    df = spark.createDataFrame(
        [("T", "a", m, 100.0, 0.0), ("T", "A ", m, 100.0, 50.0), ("T", "A", m, 400.0, 100.0), ("T", "A", None, 1.0, 1.0)],
        "town string, flat_type string, month date, resale_price double, floor_area_sqm double",
    )
    assert [tuple(r) for r in segment.monthly_rates(df).collect()] == [("T", "A", m, 3.0, 2)]


def test_last_months_are_counted_from_the_segment(spark):
    rows = [("T", "A", dt.date(y, 1, 1)) for y in (2017, 2018, 2019, 2020)] + [("U", "A", dt.date(2010, 1, 1))]
    df = spark.createDataFrame(rows, "town string, flat_type string, month date")
    made = {(r["town"], r["month"].year) for r in segment.last_months(df).collect()}
    assert made == {("T", 2018), ("T", 2019), ("T", 2020), ("U", 2010)}


SALES = f"town string, flat_type string, month date, floor_area_sqm double, remaining_lease double, {', '.join(d + ' double' for d in DISTANCES)}, resale_price double"


def random_sales(count, seed):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["T", "T", "T", "U"]),
            rng.choice(["4-room", "3 ROOM"]),
            dt.date(2015 + rng.randrange(6), rng.randrange(1, 13), 1) if rng.random() < 0.95 else None,
            float(rng.choice([0, 60, 68, 80, 85, 92, 93, 100, 115, 116])),
            float(rng.choice([0, 5, 40, 49, 50, 60, 70, 71, 95, 99])),
            *[rng.choice([0.5, 1.0, None]) for _ in DISTANCES],
            float(rng.randrange(1000)),
        )
        for _ in range(count)
    ]


def brute_comparables(rows, request, k=25):
    town, flat, area, lease = request
    near = [
        r[2:]
        for r in rows
        if r[0] == town
        and r[1].upper().replace("-", " ") == flat
        and area * 0.85 <= r[3] <= area * 1.15
        and max(0, lease - 10) <= r[4] <= min(99, lease + 10)
    ]
    last = lambda v: (v is None, v if v is not None else 0)
    near.sort(key=lambda r: ((r[0] is None, -(r[0].toordinal() if r[0] else 0)), *[last(v) for v in r[1:]]))
    return near[:k]


def test_recent_rates_are_the_last_of_all_rates(spark):
    sold = spark.createDataFrame(random_sales(800, 4), SALES)
    key = lambda rows: sorted((r["town"], r["flat_type"], r["month"], r["price_per_sqm"], r["n"]) for r in rows.collect())
    every = segment.monthly_rates(sold)
    assert key(segment.recent_rates(sold, 5)) == key(segment.last_months(every, 5)) != key(every)


def test_comparables_against_brute_force(spark):
    rows = random_sales(1500, 9)
    requests = [("T", "4 ROOM", 80.0, 60.0), ("T", "4 ROOM", 100.0, 50.0), ("T", "3 ROOM", 0.0, 95.0), ("U", "3 ROOM", 80.0, 5.0), ("V", "3 ROOM", 80.0, 5.0), ("T", "4 ROOM", 80.0, 130.0)]
    asked = spark.createDataFrame([*requests, requests[0]], "town string, flat_type string, floor_area_sqm double, remaining_lease double")
    made = segment.comparables(spark.createDataFrame(rows, SALES), asked).collect()
    for request in requests:
        mine = sorted((r for r in made if tuple(r[:4]) == request), key=lambda r: r["rank"])
        assert [tuple(r[5:]) for r in mine] == brute_comparables(rows, request), request
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_requests_that_ask_the_same_share_a_search(spark):
    rows = random_sales(300, 2)
    asked = spark.createDataFrame([(i, "T", "4 ROOM", 80.0, 60.0) for i in (1, 2)], "request_id int, town string, flat_type string, floor_area_sqm double, remaining_lease double")
    made = segment.comparables(spark.createDataFrame(rows, SALES), asked).collect()
    wanted = brute_comparables(rows, ("T", "4 ROOM", 80.0, 60.0))
    for i in (1, 2):
        mine = sorted((r for r in made if r["request_id"] == i), key=lambda r: r["rank"])
        assert [tuple(r[6:]) for r in mine] == wanted


def test_comparables_fill_missing_columns(spark):
    df = spark.createDataFrame(
        [("T", "A", dt.date(2020, 1, 1), 80.0, 60.0, 1234567.5)],
        "town string, flat_type string, month date, floor_area_sqm double, remaining_lease double, resale_price double",
    )
    asked = spark.createDataFrame([("T", "A", 80.0, 60.0)], "town string, flat_type string, floor_area_sqm double, remaining_lease double")
    row = segment.shown_comparables(segment.comparables(df, asked)).first()
    assert (row["month"], row["floor_area_sqm"], row["remaining_lease"], row["resale_price"]) == ("2020-01", "80.0", "60", "SGD 1,234,567.50")
    assert row["nearest_mrt_distance_km"] is None


def test_history_uses_the_requested_area(spark):
    rates = spark.createDataFrame([("T", "A", dt.date(2020, 1, 1), 10.0)], "town string, flat_type string, month date, price_per_sqm double")
    asked = spark.createDataFrame([("T", "A", None)], "town string, flat_type string, floor_area_sqm double")
    row = segment.segment_history(rates, asked).first()
    assert (row["price"], row["type"]) == (800.0, "Historical (area-adjusted)")
    assert segment.segment_history(rates, asked.withColumn("floor_area_sqm", F.lit(5.0))).first()["price"] == 50.0
