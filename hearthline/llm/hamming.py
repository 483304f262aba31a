"""Exact k nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments. If two codes differ in at most m*r + a bits, one of the first a+1 of m segments
differs in at most r bits or one of the others in at most r-1. So the search visits the buckets at radius 0 in every
segment, then radius 1, and so on, verifies each code it meets, and stops for a query as soon as the distance
covered that way reaches the distance of its kth verified code.

Equal codes are searched once: the index holds distinct codes with their k smallest ids, which is all that can be among
the k nearest when ties go to the smaller id. Distinct codes are dealt into shards and distinct query codes into
blocks, both of bounded size; a task searches one block in one shard, and the k best of each shard meet afterwards.
No pairs become rows: a task returns k rows per query.

Defined cases: rows with a null id, a null vector, or null or missing elements are not indexed and ask nothing. Zero and NaN
elements give a 0 bit. A vector of more than 64 elements is an error. A row given twice is two neighbours. The query itself is among its neighbours. Fewer than k
rows in all: all of them. An empty table has no neighbours. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import taken
from hearthline.operators.ordering import first_per_group
from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
FOUND = "query bigint, code bigint, distance int"


def sign_code(vector: Column) -> Column:
    """One bit per element, set where it is above zero. Null for null vectors and null elements; more than 64 elements are an error."""
    bits = F.transform(vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    long = F.raise_error(F.concat(F.lit(f"a code has {BITS} bits, a vector has elements: "), F.size(vector).cast("string")))
    return F.when(F.size(vector) > BITS, long.cast("bigint")).when((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), code)


def segments_for(codes: int) -> int:
    """As many segments as make buckets of about one code: 64 over the log of the shard's size."""
    return int(min(16, max(4, round(BITS / max(4.0, np.log2(max(codes, 2)))))))


def _bounds(m: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    cuts = [BITS * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in chosen) for chosen in combinations(range(width), radius)], np.int64)


def search_shard(queries: np.ndarray, codes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query all codes up to the distance of its kth row: positions of query and code, distance.

    `weights` says how many rows a code stands for. Distances are kept in a byte per query and code of this shard.
    """
    m = segments_for(len(codes))
    unseen = np.uint8(255)
    distance = np.full((len(queries), len(codes)), unseen, np.uint8)
    tables = []
    for first, width in _bounds(m):
        value = ((codes >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        tables.append((order, np.searchsorted(value[order], np.arange((1 << width) + 1)), first, width))
    active = np.arange(len(queries))
    radius = 0
    while len(active) and radius <= max(w for *_, w in tables):
        for j, (order, begins, first, width) in enumerate(tables):
            masks = _masks(width, radius)
            if not len(masks):
                continue
            value = ((queries[active] >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
            # A few queries at a time, so that the lists of codes met stay small.
            for at in range(0, len(active), 64):
                some = active[at : at + 64]
                probes = (value[at : at + 64, None] ^ masks[None, :]).ravel()
                sizes = begins[probes + 1] - begins[probes]
                total = int(sizes.sum())
                if not total:
                    continue
                who = np.repeat(np.repeat(some, len(masks)), sizes)
                skipped = np.repeat(np.cumsum(sizes) - sizes, sizes)
                met = order[np.repeat(begins[probes], sizes) + np.arange(total) - skipped]
                distance[who, met] = np.bitwise_count(queries[who] ^ codes[met])
            covered = m * radius + j
            # Finished: k rows verified within the distance that is covered.
            near = [int(weights[row <= covered].sum()) for row in distance[active]]
            active = active[np.array(near) < k]
            if not len(active):
                break
        radius += 1
    out = []
    for q in range(len(queries)):
        row = distance[q]
        kth = BITS
        for d, rows in enumerate(np.cumsum(np.bincount(row[row != unseen], weights[row != unseen], BITS + 1))):
            if rows >= k:
                kth = d
                break
        hit = np.flatnonzero(row <= kth)
        out.append((np.full(len(hit), q), hit, row[hit]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def nearest_codes(
    rows: DataFrame,
    asked: DataFrame,
    k: int = 10,
    shard_codes: int = 8192,
    block_queries: int = 1024,
    row_id: str = "id",
    code: str = "code",
    query_id: str = "id",
    query_code: str = "code",
) -> DataFrame:
    """The k nearest rows of each query: query_id, rank, id, distance. Ties go to the smaller id."""
    given = taken(rows, id=row_id, code=code).where("id IS NOT NULL AND code IS NOT NULL")
    queries = taken(asked, query_id=query_id, code=query_code).where("query_id IS NOT NULL AND code IS NOT NULL")
    # The k smallest ids of each code; in two rounds, so that one code may have any share of the rows.
    few = durable(first_per_group(given, ["code"], [F.col("id")], k, "place").select("code", "id"))
    index = durable(few.groupBy("code").agg(F.count(F.lit(1)).cast("int").alias("weight")))
    wanted = durable(queries.select("code").distinct())
    shards = max(1, -(-index.count() // shard_codes))
    blocks = max(1, -(-wanted.count() // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select("code", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    right = index.select("code", "weight", F.pmod(F.xxhash64("code", F.lit(2)), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))

    def search(_key: tuple, asks: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        q, c = asks["code"].to_numpy(np.int64), has["code"].to_numpy(np.int64)
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "code": [], "distance": []})
        w = has["weight"].to_numpy(np.float64)
        at, met, far = search_shard(q.view(np.uint64), c.view(np.uint64), w, k)
        return pd.DataFrame({"query": q[at], "code": c[met], "distance": far.astype(np.int32)})

    cell = ["block", "shard"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(search, FOUND)
    # At most k codes per query and distance below the kth; codes at the kth distance compete by id.
    named = found.join(few, "code").select("query", "distance", "id")
    best = first_per_group(named, ["query"], [F.col("distance"), F.col("id")], k)
    return queries.join(durable(best), F.col("code") == F.col("query")).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")
