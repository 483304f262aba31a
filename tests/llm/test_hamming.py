import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import hamming

SCHEMA = "vec_id bigint, embedding array<double>, code string, id string, rank string"


def brute(ids, codes, k):
    out = {}
    for q, c in zip(ids, codes):
        if q % 20 == 0:
            far = np.bitwise_count(codes ^ c)
            order = np.lexsort((ids, far))[:k]
            out[q] = [(int(ids[i]), int(far[i])) for i in order]
    return out


def run(spark, df, **options):
    codes = df.select("vec_id", hamming.sign_code(F.col("embedding")).alias("own"))
    asked = codes.where("vec_id % 20 = 0")
    made = hamming.nearest_codes(codes, asked, row_id="vec_id", query_id="vec_id", code="own", query_code="own", **options)
    out = {}
    for r in sorted(made.collect()):
        out.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    return out


@pytest.mark.parametrize("shard,block", [(8192, 1024), (70, 7)])
def test_same_as_brute_force(spark, shard, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x[::3] = x[0]  # a third of all rows are one vector
    x[50:80] = x[50] + 0.3 * rng.normal(size=(30, 64))
    rows = [(i, v.tolist(), "c", "i", "r") for i, v in enumerate(x)]
    made = run(spark, spark.createDataFrame(rows, SCHEMA), shard_codes=shard, block_queries=block)
    codes = np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    assert made == brute(np.arange(400), codes, 10)


def test_search_is_incremental():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, 500).astype(np.uint64)
    near = codes[:1] ^ np.uint64(5)
    at, met, far = hamming.search_shard(near, codes, np.ones(500), 1)
    # Stops once the nearest is covered: one code, two bits away.
    assert list(at) == [0] and list(met) == [0] and list(far) == [2]


def test_odd_rows(spark):
    some = [0.1] * 64
    rows = [
        (0, some, "", "", ""),
        (0, some, "", "", ""),
        (20, None, "", "", ""),
        (40, [1.0, None], "", "", ""),
        (60, [], "", "", ""),
        (None, some, "", "", ""),
        (3, [float("nan")] * 64, "", "", ""),
    ]
    made = run(spark, spark.createDataFrame(rows, SCHEMA), k=5)
    # Each of the two equal rows asks; both are found by both; nulls neither ask nor are found.
    assert made == {0: [(0, 0), (0, 0), (0, 0), (0, 0), (3, 64), (3, 64)]}
    assert run(spark, spark.createDataFrame([], SCHEMA)) == {}


def test_longer_vectors_are_an_error(spark):
    rows = [(i, [0.5] * n, "", "", "") for i, n in ((0, 64), (1, 65))]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, spark.createDataFrame(rows, SCHEMA))
