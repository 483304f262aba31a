import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.operators import retrieval
from hearthline.runtime import workspace
from hearthline.sources import corpus, files


def test_split_text_packs_words_with_overlap():
    assert retrieval.split_text("aaa bbb ccc ddd", 10, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert retrieval.split_text("short", 10, 4) == ["short"]
    assert retrieval.split_text(" \n ", 10, 4) == []


def test_split_text_prefers_paragraphs_then_lines():
    body = "first one\n\nsecond\nthird"
    assert retrieval.split_text(body, 15, 0) == ["first one", "second\nthird"]
    # A piece too long for one chunk is cut further, and chunks do not span its edges.
    assert retrieval.split_text("ab\n\ncdefghijkl\n\nm", 5, 2) == ["ab", "cdef", "efghi", "hijkl", "m"]


def test_split_text_cuts_long_words():
    chunks = retrieval.split_text("x" * 12, 5, 2)
    assert chunks == ["x" * 5, "x" * 5, "x" * 5, "x" * 3]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(4, 20), st.integers(0, 3))
def test_split_text_keeps_everything(body, size, overlap):
    chunks = retrieval.split_text(body, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for chunk in chunks:
        found = body.find(chunk, max(0, at - size))
        assert found >= 0
        at = max(at, found + len(chunk))
    assert sum(c in "ab" for c in "".join(chunks)) >= sum(c in "ab" for c in body)


def chunks_by_the_book(body, size, overlap, marks=("\n\n", "\n", " ", "")):
    """The splitter's published rules over plain lists: cut, keep the mark in front, merge, recurse."""
    at = next(i for i, m in enumerate(marks) if m in body)
    mark, rest = marks[at], marks[at + 1 :]
    parts = list(body) if mark == "" else [p if i == 0 else mark + p for i, p in enumerate(body.split(mark))]
    chunks, fitting = [], []

    def merge(pieces):
        merged, current = [], []
        for piece in pieces:
            if current and len("".join(current)) + len(piece) > size:
                merged.append("".join(current).strip())
                while current and (len("".join(current)) > overlap or len("".join(current)) + len(piece) > size):
                    current = current[1:]
            current = current + [piece]
        return [m for m in [*merged, "".join(current).strip()] if m]

    for part in [p for p in parts if p]:
        if len(part) < size:
            fitting.append(part)
            continue
        chunks += merge(fitting)
        fitting = []
        chunks += chunks_by_the_book(part, size, overlap, rest) if rest else [part]
    return chunks + merge(fitting)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé \n", max_size=120), st.integers(2, 25), st.integers(0, 10))
def test_split_text_by_the_book(body, size, overlap):
    overlap = min(overlap, size - 1)
    assert retrieval.split_text(body, size, overlap) == chunks_by_the_book(body, size, overlap)


def test_split_text_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for row in rows[:40]:
        assert retrieval.split_text(row["text"]) == chunks_by_the_book(row["text"], 300, 50)


@pytest.mark.parametrize("length,count", [(0, 0), (1, 1), (51, 1), (52, 1), (300, 1), (301, 2), (550, 2), (551, 3)])
def test_stride_chunks(spark, length, count):
    body = "".join(chr(97 + i % 26) for i in range(length))
    rows = retrieval.stride_chunks(spark.createDataFrame([(1, body)], "id int, t string"), "t").orderBy("chunk_no").collect()
    assert [r["chunk"] for r in rows] == [body[i : i + 300] for i in range(0, max(length - 50, 1), 250)][:count]
    assert len(rows) == count


def test_recursive_chunks_run_on_spark(spark):
    df = spark.createDataFrame([(1, "aaa bbb ccc ddd"), (2, ""), (3, None)], "id int, t string")
    rows = retrieval.recursive_chunks(df, "t", 10, 4).orderBy("chunk_no").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "aaa bbb"), (1, 1, "bbb ccc"), (1, 2, "ccc ddd")]


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (7, 3), (25, 24), (300, 50)])
def test_recursive_chunks_are_those_of_the_plain_splitter(spark, size, overlap):
    rng = np.random.default_rng(size)
    marks = ["\n\n", "\n", " ", "a", "é", "bc", "\u2003", "\t", "😀", "x" * 40, "word ", "line\n"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 120))) for _ in range(150)] + ["y" * 4000, "a b " * 3000, "\n\n\n\n", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    made = {}
    for r in retrieval.recursive_chunks(df, "t", size, overlap).orderBy("id", "chunk_no").collect():
        made.setdefault(r["id"], []).append(r["chunk"])
        assert r["chunk_no"] == len(made[r["id"]]) - 1
    assert made == {i: c for i, t in enumerate(texts) if (c := retrieval.split_text(t, size, overlap) if t else [])}
    plan = retrieval.recursive_chunks(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_nearest_against_numpy(spark, block):
    rng = np.random.default_rng(1)
    stored = rng.normal(size=(300, 8)).astype("float32")
    stored[50:150] = stored[50]
    stored[7] = 0
    asked = rng.normal(size=(17, 8))
    asked[3] = stored[50]
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], "id bigint, embedding array<float>").repartition(5)
    store = store.unionByName(spark.createDataFrame([(999, None)], "id bigint, embedding array<float>"))
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)] + [("zero", [0.0] * 8)], "q string, embedding array<double>")
    made = retrieval.nearest(store, queries, "id", "q", k=3, block_bytes=block).collect()
    with np.errstate(invalid="ignore"):
        scores = (asked @ stored.T) / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(stored, axis=1)
    scores[:, 7] = -9
    for i in range(17):
        wanted = sorted(range(300), key=lambda j: (-round(scores[i, j], 9), j))[:3]
        mine = sorted((r for r in made if r["q"] == f"q{i}"), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == wanted
        assert [r["similarity"] for r in mine] == pytest.approx([scores[i, j] for j in wanted])
    assert not [r for r in made if r["q"] == "zero"]
    assert retrieval.nearest(store, queries.where("q = 'zero'"), "id", "q").count() == 0


def test_context(spark):
    df = spark.createDataFrame([("q", 2, "it's", "two"), ("q", 1, "x", "one")], "q string, rank int, area string, t string")
    made = retrieval.context(df, "q", retrieval.shown_metadata({"Area": F.col("area")}), F.col("t")).first()["context"]
    assert made == "Source: {'Area': 'x'}\nContent: one\n\nSource: {'Area': \"it's\"}\nContent: two"


ENTRY = {"area": "Nowhere", "hdb_price_range": "SGD 1K - 2K", "pros": ["quiet", "it's far"], "cons": []}


def write(folder, name, entries):
    (folder / name).write_text(json.dumps(entries), encoding="utf-8")


def test_many_queries_at_once(spark, monkeypatch):
    """50 000 queries in several blocks, around several pivots, over several shards; the store is scanned once for all."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    stored = centres[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 6))
    asked = centres[rng.integers(0, 12, 50_000)] + 0.2 * rng.normal(size=(50_000, 6))
    frame = lambda v, name: spark.createDataFrame(pa.table({name: np.arange(len(v)), "embedding": v.tolist()}))
    monkeypatch.setattr(retrieval, "MOST_PIVOTS", 9)
    store, queries = frame(stored, "id"), frame(asked, "q")
    made = retrieval.nearest(store, queries, "id", "q", k=2, block_bytes=200_000, cell_bytes=60_000)
    got = made.toPandas().sort_values(["q", "rank"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(stored).T, 12)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :2]
    assert (got["id"].to_numpy().reshape(-1, 2) == best).all()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_ids_of_several_fields(spark):
    store = spark.sql("SELECT struct(2 AS a, 1L AS b) AS id, array(1.0, 0.0) AS embedding UNION ALL SELECT struct(1, 9L), array(2.0, 0.0) UNION ALL SELECT struct(1, 3L), array(3.0, 0.0)")
    asked = spark.sql("SELECT 'x' AS q, array(1.0, 0.0) AS embedding")
    made = retrieval.nearest(store, asked, "id", "q", k=2).orderBy("rank").collect()
    assert [tuple(r["id"]) for r in made] == [(1, 3), (1, 9)]


def test_json_to_documents(spark, tmp_path):
    write(tmp_path, "a.json", [ENTRY, ENTRY | {"area": "Elsewhere", "nearby_amenities": ["Mall"]}])
    write(tmp_path, "b.json", [ENTRY | {"area": "Third", "has_hdb": True}])
    write(tmp_path, "c.txt", "not read")
    areas = corpus.read_areas(spark, str(tmp_path))
    made = {r["area"]: r for r in retrieval.assemble(areas).collect()}
    assert set(made) == {"Nowhere", "Elsewhere", "Third"} == {r["area"] for r in corpus.area_names(areas).collect()}
    assert made["Nowhere"]["page_content"] == (
        "Area: Nowhere\nHDB Price range: SGD 1K - 2K\nPros: " + repr(ENTRY["pros"]) + "\nCons: []\nNearby Amenities: []"
    )
    assert made["Elsewhere"]["page_content"].endswith("Nearby Amenities: ['Mall']")
    assert made["Third"]["metadata"]["Source"].endswith("/b.json")
    some = corpus.read_areas(spark, [str(tmp_path / "b.json")])
    older = retrieval.assemble(some, with_availability=True).first()
    assert "\nHDB Available: True\nHDB Price range" in older["page_content"] and older["metadata"] == {"Area": "Third"}


def test_entry_without_a_needed_field_fails(spark, tmp_path):
    write(tmp_path, "a.json", [{k: v for k, v in ENTRY.items() if k != "pros"}])
    with pytest.raises(Exception, match="entry without 'pros'"):
        retrieval.assemble(corpus.read_areas(spark, str(tmp_path))).collect()


def test_fingerprints(spark, tmp_path):
    def mark(rows):
        return corpus.fingerprint(spark.createDataFrame(rows, "id int, t string").repartition(3), ["id", "t"]).first()["fingerprint"]

    base = mark([(1, "a"), (2, "b")])
    assert base == mark([(2, "b"), (1, "a")])
    assert len({base, mark([(1, "a"), (2, "c")]), mark([(1, "a"), (2, "b"), (2, "b")]), mark([(1, "a"), (2, None)])}) == 4
    write(tmp_path, "a.json", [ENTRY])
    first = corpus.file_fingerprint(spark, str(tmp_path)).first()["fingerprint"]
    assert first == corpus.file_fingerprint(spark, str(tmp_path)).first()["fingerprint"]
    write(tmp_path, "b.json", [ENTRY])
    assert first != corpus.file_fingerprint(spark, str(tmp_path)).first()["fingerprint"]


def test_index_is_reused_and_older_ones_removed(spark):
    folder = f"{workspace(spark)}/test-index"
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert corpus.stored_index(spark, folder, "aa", lambda: build(3)).count() == 3
    assert corpus.stored_index(spark, folder, "aa", lambda: build(4)).count() == 3
    assert corpus.stored_index(spark, folder, "bb", lambda: build(5)).count() == 5
    assert built == [3, 5]
    assert [p.rsplit("/", 1)[1] for p in files.children(spark, folder)] == ["fingerprint=bb"]


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.0, 1.0]), (None, [9.0, 9.0])], "label int, embedding array<double>")
    made = {r["label"]: r["embedding"] for r in retrieval.mean_vectors(df, "label", "embedding").collect()}
    assert made == {1: [2.0, 4.0], 2: [0.0, 1.0]}


def test_words_are_not_cut_apart_before_they_are_packed(spark):
    body = "word " * 1000 + "x" * 20 + " more" * 3 + " " + "y" * 10
    df = spark.createDataFrame([(body,)], "t string")
    run = F.struct(F.col("t").alias("text"), F.lit("").alias("mark"), F.lit(True).alias("open"))
    found = df.select(retrieval._cut_open(F.array(run), " ", 10).alias("runs")).first()["runs"]
    assert [(r["text"], r["open"]) for r in found] == [
        ("word " * 999 + "word", False), (" " + "x" * 20, True), (" more" * 3, False), (" " + "y" * 10, True)
    ]


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (12, 5), (40, 30)])
def test_recursive_chunks_with_many_line_breaks(spark, size, overlap):
    rng = np.random.default_rng(size)
    marks = ["\n", "\n\n", "\n\n\n", "a", "bc", " ", "word word", "é" * 7]
    texts = ["".join(rng.choice(marks, rng.integers(1, 400))) for _ in range(150)] + ["ab\n\n" * 1500, ("z" * 60 + " ") * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    made = {}
    for r in retrieval.recursive_chunks(df, "t", size, overlap).orderBy("id", "chunk_no").collect():
        made.setdefault(r["id"], []).append(r["chunk"])
    assert made == {i: c for i, t in enumerate(texts) if (c := retrieval.split_text(t, size, overlap))}


def test_rows_that_share_a_vector_are_thinned_before_they_are_stored(spark):
    rows = [((d, c), [float(d), 1.0]) for d in range(3) for c in range(50, 0, -1)]
    df = spark.createDataFrame(rows, "_id struct<d: int, c: int>, _v array<double>").coalesce(1)
    kept = retrieval._by_pivot(df, np.array([[1.0, 0.0]]), 2).collect()
    assert sorted((r["_id"]["d"], r["_id"]["c"]) for r in kept) == [(d, c) for d in range(3) for c in (1, 2)]
