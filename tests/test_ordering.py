import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators import ordering
from hearthline.operators.ordering import first_per_group, newest_rows, with_position


def test_positions_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 40)
    rng = random.Random(3)
    rows = [(k, o) for k in ("hot", "b", "c") for o in rng.sample(range(-500, 5000), 300 if k == "hot" else 7)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    made = with_position(df, ["k"], "o", "place", total="rows", first="lowest").collect()
    for k in ("hot", "b", "c"):
        orders = sorted(o for key, o in rows if key == k)
        mine = [r for r in made if r["k"] == k]
        assert {(r["o"], r["place"]) for r in mine} == {(o, i + 1) for i, o in enumerate(orders)}
        assert {(r["rows"], r["lowest"]) for r in mine} == {(len(orders), orders[0])}
    everywhere = with_position(df.select("o").distinct(), [], "o", "place").collect()
    assert [r["place"] for r in sorted(everywhere)] == list(range(1, len(everywhere) + 1))


def test_sparse_orders_make_few_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 1000)
    df = spark.range(20_000).selectExpr("xxhash64(id) AS o")
    sizes = [r["n"] for r in ordering.by_chunk(df, [], ordering.chunks(df, "o"), {"n": F.count(F.lit(1))}).collect()]
    assert 15 <= len(sizes) <= 20 and max(sizes) < 2500
    made = sorted(tuple(r) for r in with_position(df, [], "o", "place").collect())
    assert [p for _, p in made] == list(range(1, 20_001))


def test_thousands_of_chunks(spark, monkeypatch):
    """Cuts are found level by level, so their number has no limit (up to twice as many as asked for); equal values share a chunk."""
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 4)
    monkeypatch.setattr(ordering, "PARTS", 12)
    df = spark.range(9000).selectExpr("CASE WHEN id % 10 = 0 THEN 77 ELSE xxhash64(id) END AS o", "id")
    sizes = [r["n"] for r in ordering.by_chunk(df, [], ordering.chunks(df, "o"), {"n": F.count(F.lit(1))}).collect()]
    assert 1000 < len(sizes) <= 4500 and sorted(sizes)[-2] <= 40 and sorted(sizes)[-1] >= 900
    made = with_position(df.where("o <> 77"), [], "o", "place").orderBy("o").collect()
    assert [r["place"] for r in made] == list(range(1, 8101))


def test_rows_are_shuffled_by_group_and_chunk(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 3)
    made = with_position(spark.range(10).selectExpr("id % 2 as k", "id as o", "uuid() as t"), ["k"], "o", "place")
    lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
    numbering = next(line for line in lines if "Window [row_number()" in line)
    assert "_chunk" in numbering.split("windowspecdefinition(")[1].split(" ASC")[0]


def test_first_per_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else str(rng.randrange(5)), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(8)
    made = first_per_group(df, ["k"], [F.desc("v"), F.col("i")], 5, parts=3)
    for k in {r[0] for r in rows}:
        wanted = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:5]
        mine = sorted((r for r in made.collect() if r["k"] == k), key=lambda r: r["rank"])
        assert [(r["k"], r["v"], r["i"]) for r in mine] == wanted
        assert [r["rank"] for r in mine] == list(range(1, len(wanted) + 1))
    assert made._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4


@pytest.mark.parametrize("n", [0, 1, 7, 25, 40, 400])
def test_newest_rows(spark, n):
    rng = random.Random(6)
    rows = [(dt.date(2024, rng.randrange(1, 6), 1), rng.randrange(30), i // 4) for i in range(60)]
    rows += [(dt.date(2024, 3, 1), 7, 99)] * 40
    df = spark.createDataFrame(rows, "day date, v int, i int")
    made = newest_rows(df, n, "day", [F.col("v").cast("string")]).collect()
    import hashlib

    wanted = sorted(rows, key=lambda r: (-r[0].toordinal(), hashlib.md5(str(r[1]).encode()).hexdigest(), r[1], r[2]))
    assert sorted(tuple(r) for r in made) == sorted(wanted[:n])
