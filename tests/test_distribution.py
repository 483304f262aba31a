import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.operators import distribution as module
from hearthline.operators.distribution import distribution, histogram, value_slice

QUANTILES = {"q05": 0.05, "median": 0.5, "q95": 0.95}


def brute(frame, keys):
    found = {}
    for key, values in frame.groupby(keys, dropna=False)["v"]:
        v = values.dropna()
        found[key] = [len(v)] + ([v.mean(), v.min(), v.max(), *v.quantile(list(QUANTILES.values()))] if len(v) else [None] * 6)
    return found


def same(made, wanted):
    assert set(made) == set(wanted)
    for key in wanted:
        for a, b in zip(made[key], wanted[key]):
            assert a == b if a is None or b is None else a == pytest.approx(b, rel=1e-12, abs=1e-12), (key, made[key], wanted[key])


def test_against_pandas_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    size = 6000
    group = np.where(rng.random(size) < 0.4, "hot", rng.integers(0, 40, size).astype(str))
    values = np.round(rng.lognormal(12, 1, size), 2) * np.where(rng.random(size) < 0.1, -1, 1)
    values[rng.random(size) < 0.3] = 500000.0
    frame = pd.DataFrame({"g": group, "v": values})
    made = distribution(spark.createDataFrame(frame), ["g"], "v", QUANTILES)
    same({r["g"]: list(r[1:]) for r in made.collect()}, brute(frame, "g"))


@pytest.mark.parametrize("null_keys", [False, True])
def test_large_cells_are_cut_until_they_are_small(spark, monkeypatch, null_keys):
    monkeypatch.setattr(module, "LARGEST_CELL", 4)
    monkeypatch.setattr(module, "CELLS", 3)
    monkeypatch.setattr(module, "SLICES_PER_E_FOLD", 1)
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 3000), "v": np.round(rng.normal(0, 5000, 3000), 1)})
    frame.loc[rng.random(3000) < 0.4, "v"] = 123.4
    frame = pd.DataFrame({"g": [*frame["g"], "nothing"], "v": [*frame["v"], np.nan]})
    made = distribution(spark.createDataFrame(frame), ["g"], "v", QUANTILES, null_keys=null_keys)
    assert "_cell3" in made._jdf.queryExecution().analyzed().toString()
    same({r["g"]: list(r[1:]) for r in made.collect()}, brute(frame, "g"))


def test_counted_rows_are_cut_too(spark, monkeypatch):
    """300 000 different sizes in one slice: no cell whose values are ranked has more rows than allowed."""
    monkeypatch.setattr(module, "LARGEST_CELL", 1000)
    most = []
    attach = module.attach

    def watched(left, right, keys, null_keys=False):
        if "_rows" not in right.columns:
            inside = attach(left, right, keys, null_keys).groupBy(*keys).count()
            most.append(inside.agg({"count": "max"}).first()[0])
        return attach(left, right, keys, null_keys)

    monkeypatch.setattr(module, "attach", watched)
    rows = spark.range(300_000).selectExpr("id % 2 AS g", "100 + id / 3000000 AS v", "1 + id % 3 AS times")
    made = {r["g"]: r for r in distribution(rows, ["g"], "v", QUANTILES, weight="times").collect()}
    assert most and max(most) <= 1000
    for g in (0, 1):
        values = np.repeat(100 + np.arange(g, 300_000, 2) / 3_000_000, 1 + np.arange(g, 300_000, 2) % 3)
        assert made[g]["n"] == len(values)
        for name, p in QUANTILES.items():
            assert made[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_null_keys_empty_groups_and_nan(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 4.0), (None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    kept = {r["g"]: (r["n"], r["median"]) for r in distribution(df, ["g"], "v", QUANTILES, null_keys=True).collect()}
    assert kept == {"a": (2, 2.5), None: (1, 7.0), "b": (0, None)}
    left = {r["g"] for r in distribution(df, ["g"], "v", QUANTILES).collect()}
    assert left == {"a", "b"}


def test_without_keys_and_with_weights(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4), (None, 9)], "v double, w int")
    row = distribution(df, [], "v", QUANTILES, weight="w").first()
    spread = pd.Series([1.0] * 3 + [2.0] + [10.0] * 4)
    assert (row["n"], row["median"], row["mean"]) == (8, spread.median(), pytest.approx(spread.mean()))
    assert row["q95"] == spread.quantile(0.95)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=30), st.floats(0, 1))
def test_any_values(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    made = distribution(df, [], "v", {"q": p}).first()["q"]
    assert made == pytest.approx(np.quantile(np.array(values), p), rel=1e-9, abs=1e-6)


def test_slices_never_fall(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, 1.0000001, -5.0, 1e300, -1e300, float("inf"), float("-inf"), 3.5, 2e5])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_slice(F.col("v")).alias("s"))
    slices = [r["s"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert slices == sorted(slices)


def chart_bins(values, most=35):
    """The chart library's published binning rule, step by step."""
    low, high = min(values), max(values)
    span = (high - low) or abs(low) or 1
    level = math.ceil(math.log(most) / math.log(10))
    step = 10 ** (round(math.log(span) / math.log(10)) - level)
    while math.ceil(span / step) > most:
        step *= 10
    for part in (5, 2):
        if span / (step / part) <= most:
            step /= part
    v = math.log(step)
    precision = 0 if v >= 0 else int(-v / math.log(10)) + 1
    edge = math.floor(low / step + 10 ** (-precision - 1)) * step
    start = edge - step if low < edge else edge
    stop = math.ceil(high / step) * step
    stop = start + step if stop == start else stop
    counts = {}
    for x in values:
        b = math.floor(1e-14 + (max(start, min(x, stop - step)) - start) / step)
        counts[b] = counts.get(b, 0) + 1
    return step, counts


@pytest.mark.parametrize(
    "values", [[5.0], [0.0, 0.0], [1.0, 2.0, 3.0, 35.0], [901.82, 50000.0, 104997.88], [0.001, 0.0123, 0.02], [-7.0, 7.0, 70.0]]
)
def test_histogram(spark, values):
    df = spark.createDataFrame([("t", v) for v in values], "town string, v double")
    rows = histogram(df, ["town"], "v").collect()
    step, counts = chart_bins(values)
    assert {r["bin"]: r["n"] for r in rows} == counts
    assert all(r["total"] == len(values) for r in rows)
    assert all(r["bin_end"] - r["bin_start"] == pytest.approx(step) for r in rows)


def test_plan_has_no_percentile_and_broadcasts_the_slices(spark):
    df = spark.range(1000).selectExpr("id % 7 as g", "cast(id as double) as v")
    made = distribution(df, ["g"], "v", QUANTILES)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    for unwanted in ("percentile", "median(", "ObjectHashAggregate", "Python", "NestedLoop", "Cartesian"):
        assert unwanted not in plan
