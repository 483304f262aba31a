"""Connected components by a distributed union-find."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a part of a stored table, about. Parts follow the rows there are, so that small rounds have few tasks.
PART_ROWS = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of all links of a task, which are at most PART_ROWS: the rounds of union_find() on arrays."""
    given = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not given:
        return
    ids, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*given)]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], ["id", "root"])


def union_find(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that links (a, b) reach, for each id in them.

    Every id points at itself or a smaller one. A round hooks each tree that a link joins to a tree with a smaller root
    under the smallest such root, and then lets every id point at its parent's parent until all point at roots. Links
    within a tree are dropped, so that the rounds get smaller; there are about log of the longest chain. Each round is
    stored, so that a lost executor does not bring the earlier ones back. Links from an id to itself are ignored.
    Up to PART_ROWS links, what one task of a round would hold, go through all rounds in that task.
    """
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    count = edges.count()
    if count <= PART_ROWS:
        return durable(edges.coalesce(1).mapInArrow(_joined, "id bigint, root bigint"))
    # No table below has more than two rows for a link.
    parts = -(-2 * count // PART_ROWS)
    store = lambda df: durable(df.coalesce(parts))
    ends = edges.select(F.col("b").alias("id"), F.col("a").alias("root")).union(edges.select("a", "a"))
    parent = store(ends.groupBy("id").agg(F.min("root").alias("root")))
    while True:
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
            moved = F.max((F.col("root") != F.col("above")).cast("int"))
            step = store(parent.join(up, "root").select("id", "root", "above"))
            parent = step.select("id", F.col("above").alias("root"))
            if not step.agg(moved).first()[0]:
                break
        left = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        between = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = store(between.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return parent
        hooks = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        parent = durable(parent.join(hooks, "id", "left").select("id", F.coalesce("to", "root").alias("root")))
