"""JSON arrays read by splits: the entries of any file, whatever its layout and wherever it is cut."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from hearthline.sources import arrays, corpus


def value(rng, depth=0):
    pick = rng.randrange(8 if depth < 3 else 5)
    if pick < 3:
        signs = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "a", "😀", " ", '\\"', '"}', "},{"]
        return "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
    if pick < 5:
        return rng.choice([None, True, 1.5, -3, 0])
    if pick < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def entry(rng):
    return {"name": value(rng), "more": [value(rng) for _ in range(rng.randrange(5))]} | ({"x": {}} if rng.random() < 0.2 else {})


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    yield lambda size: [spark.conf.set(names[0], str(size)), spark.conf.set(names[1], "0"), spark.conf.set(names[2], "1")]
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_entries_of_any_cut(spark, tmp_path, small_splits, indent):
    rng = random.Random(6)
    files = {f"f{i}.json": [entry(rng) for _ in range(n)] for i, n in enumerate((0, 1, 7, 120))}
    for name, entries in files.items():
        (tmp_path / name).write_text(json.dumps(entries, indent=indent, ensure_ascii=rng.random() < 0.5), encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps({"name": "}"}) + "\n")
    (tmp_path / "other.txt").write_text("no JSON")
    for size in (97, 1 << 20):
        small_splits(size)
        got = {}
        for r in arrays.entries(spark, str(tmp_path)).orderBy("source", "entry_no").collect():
            got.setdefault(r["source"].rsplit("/", 1)[1], []).append(json.loads(r["entry"]))
        assert got == {n: e for n, e in files.items() if e} | {"one.json": [{"name": "}"}]}


@pytest.mark.parametrize("bad", ["[1, 2]", '[{"a": 1}, 2, {"b": 3}]', '[{"a": 1}', '[{"a": "x}]', '[{"a": 1}] {"b": 2}', "text", '[{"a": 1}]]'])
def test_broken_files_fail(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(bad)
    with pytest.raises(PySparkException):
        arrays.entries(spark, str(tmp_path)).collect()


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    """The rows of the line form, from one file without a line break; no split, and so no task, has more than a part of it."""
    profile = {"area": "A", "hdb_price_range": "1", "pros": ["near {the} park", 'a "good" school'], "cons": ["x" * 900]}
    rows = [profile | {"area": f"Area {i}"} for i in range(20_000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "all.json").write_text(json.dumps(rows))
    (tmp_path / "b" / "all.json").write_text("\n".join(map(json.dumps, rows)))
    small_splits(2 << 20)
    made = corpus.read_areas(spark, str(tmp_path / "a"))
    wanted = corpus.read_areas(spark, str(tmp_path / "b"), lines=True)
    assert made.drop("source").exceptAll(wanted.drop("source")).isEmpty() and made.count() == 20_000
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "a"))
    assert pieces.rdd.getNumPartitions() >= 8


def test_arrays_are_written_and_read(spark, tmp_path):
    df = spark.range(2500).selectExpr("concat('Area ', id) AS area", "'1' AS hdb_price_range", "array('p{') AS pros", "array('c') AS cons")
    corpus.write_arrays(df, str(tmp_path), per_file=400)
    back = corpus.read_areas(spark, str(tmp_path), pattern="*.txt").select(*df.columns)
    assert back.count() == 2500 and back.exceptAll(df).isEmpty()


def test_text_is_stored_once(spark, tmp_path, monkeypatch):
    stored, durable = [], arrays.durable

    def noted(df):
        stored.append(df.columns)
        return durable(df)

    monkeypatch.setattr(arrays, "durable", noted)
    (tmp_path / "a.json").write_text('[{"a": "x}\\"{"}, {"b": [1, {"c": "]"}]}]')
    found = arrays.entries(spark, str(tmp_path)).orderBy("entry_no").collect()
    assert [r["entry"] for r in found] == ['{"a": "x}\\"{"}', '{"b": [1, {"c": "]"}]}']
    assert sum("value" in columns for columns in stored) == 1
