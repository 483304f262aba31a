"""Each stage against a brute-force version of it, on what the stage before kept."""

import public_tokenizers

import corpus_pipeline
from hearthline.llm import langid
from hearthline.llm.common import fold
from pyspark.sql import functions as F

from .helpers import frame, odd_texts
from .test_decontaminate import brute as brute_hits
from .test_jaccard import brute as brute_near
from .test_lines import shingles
from .test_packing import check

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def without_repeats(docs):
    """Keeps each line unless an earlier one is similar, by components over all pairs that share a shingle."""
    found = [((i, k), x.strip(" \t\r\f\x0b").lower()) for i in sorted(docs) for k, x in enumerate((docs[i] or "").split("\n"))]
    found = [(p, x) for p, x in found if x]
    first, root = {}, {}
    for p, x in found:
        root[p] = first.setdefault(x, p)
    owners, sets = {}, {p: shingles(x) for x, p in first.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, s in sets.items():
        shared = {}
        for g in s:
            for q in owners.setdefault(g, []):
                shared[q] = shared.get(q, 0) + 1
            owners[g].append(p)
        for q, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[q]) - both):
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    gone = {p for p, _ in found if find(p) != p}
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if (i, k) not in gone]
        if len(kept) == len(lines):
            out[i] = t
        elif any(x.strip() for x in kept):
            out[i] = "\n".join(kept)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file:{tmp_path}/{name}")
        before, docs = texts_of(docs), spark.read.parquet(f"file:{tmp_path}/{name}")
        if name == "sequences":
            break
        after = texts_of(docs)
        assert docs.columns == columns
        ids = sorted(before)
        if name == "language_id":
            assert after == before  # all of these are in a language that is taught
        elif name == "line_dedup":
            assert after == without_repeats(before)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "near_duplicates":
            root = brute_near([before[i] for i in ids])
            assert after == {i: before[i] for k, i in enumerate(ids) if root[k][1] == k}
        else:
            hits = brute_hits([before[i] for i in ids], items, 10)
            assert after == {i: before[i] for k, i in enumerate(ids) if not hits[k][1]}
            assert len(after) < len(before)
    ids = sorted(before)
    rows = [r.asDict() | {"doc_id": ids.index(r["doc_id"])} for r in docs.collect()]
    check(rows, [before[i] for i in ids], 4096)


def test_run_is_the_stages_in_turn(spark):
    made = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sequences"]
    assert made.count() > 50 and made.agg(F.max("length")).first()[0] <= 4096
    assert public_tokenizers.path("word_bpe_49k.json")


def test_odd_and_empty_documents(spark, tmp_path):
    for n, docs in enumerate((frame(spark, odd_texts()), frame(spark, []))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"file:{tmp_path}/{n}/{name}")
            docs = spark.read.parquet(f"file:{tmp_path}/{n}/{name}")
            assert name == "sequences" or docs.columns == columns


def test_language_stage_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = frame(spark, [(10**6, "Совсем другой язык, не такой как все. " * 9), (10**6 + 1, "12 !"), (10**6 + 2, None)], clash=False)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(odd.withColumn("lang", F.lit(None).cast("string"))), SF)
    assert kept.count() == docs.count() and kept.where("doc_id >= 1000000").count() == 0
    assert langid.UNKNOWN == "und" and fold is not None
