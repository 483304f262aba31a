import numpy as np
import pyarrow as pa
import pytest

from hearthline import runtime
from hearthline.llm import common, components, similar


def rows(found):
    """What _with_leaders gives for (key, id, n, leader) rows in batches of 7."""
    found = sorted(found)
    key, ids, n, leader = zip(*found)
    t = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((key, [0] * len(key), ids, n, leader), similar.KEYS_ARROW)], schema=similar.KEYS_ARROW)
    return [r for b in similar._with_leaders(iter(t.to_batches(7))) for r in b.to_pylist()]


def test_keys_with_the_same_rows_are_one_key():
    made = rows([(k, i, None, None) for k in range(60) for i in (3, 8, 9)])
    assert len({r["key"] for r in made}) < 30 and {(r["id"], r["leader"]) for r in made} == {(3, 3), (8, 3), (9, 3)}


def test_keys_of_rows_that_lead_others_stay():
    made = rows([(k, i, similar.LEADS if i == 3 else None, None) for k in range(60) for i in (3, 8)])
    assert {r["key"] for r in made} == set(range(60)) and all(r["n"] is None for r in made)


def test_key_rows_mark_those_that_lead_others():
    key = np.array([1, 1, 2], np.int64)
    made = similar.key_rows(key, np.zeros(3, np.int64), np.array([5, 4, 6]), np.full(3, -1, np.int32)).to_pylist()
    assert sorted((r["key"], r["id"], r["n"], r["leader"]) for r in made if r["leader"] is None) == [(1, 4, similar.LEADS, None), (2, 6, None, None)]
    assert sorted((r["key"], r["id"], r["leader"]) for r in made if r["leader"] is not None) == [(1, 4, 4), (1, 5, 4)]


@pytest.mark.parametrize("most", [2, 9, 300])
def test_bound_of_all_pairs_rules_nothing_out(most):
    rng = np.random.default_rng(most)
    sketch = np.minimum(rng.integers(0, most, (40, similar.CELLS)) * (rng.random((40, 1)) < 0.9), 255).astype(np.uint8)
    sketch[20:] = np.maximum(sketch[:20].astype(int) - (rng.random((20, similar.CELLS)) < 0.1), 0)
    n = sketch.sum(1, dtype=np.int64) + 1
    i, j = (x.ravel() for x in np.indices((40, 40)))
    wanted = similar.may_be_similar(n[i], n[j], sketch[i], sketch[j], 80).reshape(40, 40)
    found = similar.may_all_be_similar(n, n, sketch, sketch, 80)
    assert (found | ~wanted).all() and wanted.any() and (most > 3 or (found == wanted).all())


def test_few_links_need_no_rounds_of_jobs(spark, monkeypatch):
    stored, durable = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: stored.append(1) or durable(df))
    links = spark.createDataFrame([*((i + 1, i) for i in range(100, 160)), (7, 3), (5, 5), (9, 7)], "a bigint, b bigint")
    made = dict(tuple(r) for r in components.union_find(links).collect())
    assert made == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3} and len(stored) == 2
    monkeypatch.setattr(components, "PART_ROWS", 1)
    assert dict(tuple(r) for r in components.union_find(links).collect()) == made


def tile_of(key, ids, sets):
    n, _, sketch = zip(*(similar.set_row(sets[i]) for i in ids))
    m = len(ids)
    columns = {"id": ids, "key": [key] * m, "block": [0] * m, "root": ids, "row": [0] * m, "col": [0] * m, "n": n, "sketch": sketch}
    return pa.RecordBatch.from_pydict(columns)


def test_large_sets_are_told_apart_in_large_tiles():
    rng = np.random.default_rng(1)
    sets = {i: np.unique(rng.integers(0, 1 << 63, 2000, np.uint64)) for i in range(similar.LARGE + 10)}
    sets[5] = sets[3][:-20]
    made = [r for b in similar._tile_pairs(80, None)(iter([tile_of(1, list(sets), sets)])) for r in b.to_pylist()]
    assert made == [{"a": 3, "b": 5}]


def test_a_pair_of_many_keys_comes_out_once():
    sets = {i: np.arange(1, 60, dtype=np.uint64) << np.uint64(40) for i in (3, 8, 9)}
    batches = [tile_of(k, ids, sets) for k in range(5) for ids in ([3, 8], [3, 8, 9])]
    made = [tuple(r.values()) for b in similar._tile_pairs(80, None)(iter(batches)) for r in b.to_pylist()]
    assert sorted(made) == [(3, 8), (3, 9), (8, 9)]


def test_a_worker_makes_powers_once():
    assert np.shares_memory(common.powers(10)[0], common.powers(2000)[0]) and common.powers(10)[1][3] == common.powers(common.PIECE + 9)[1][3]


def test_pairs_meet_their_sets_without_a_shuffle_of_them(spark):
    sets = spark.createDataFrame([(i, 1, b"t", b"s") for i in range(40)], similar.SETS)
    stored = runtime.durable_by(sets.repartition(8, "id"), "id")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(39)], similar.PAIRS)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ends = similar._ends(pairs, stored, "n")
        plan = ends._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and ends.count() == 39
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("step_")]
