"""Resampling against plain Python, and the cutoff against a sort."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from hearthline.llm import resample
from tests.llm.helpers import frame, odd_texts, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def found(text, longest, buckets):
    words = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(words[i : i + r]) for r in range(1, longest + 1) for i in range(len(words) - r + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, percent, seed, least_words, longest, buckets):
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    each = [found(text, longest, buckets) for _, text in docs]
    for side, all_found in ((s, [f for _, f in each]), (t, [found(x, longest, buckets)[1] for x in target])):
        for f in all_found:
            np.add.at(side, f, 1)
    ratio = lambda b: float(t[b] + 1) * float(t_all) / (float(s[b] + 1) * float(s_all))
    s_all, t_all = int(t.sum()) + buckets, int(s.sum()) + buckets
    gain = [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]
    rows = []
    for (doc_id, _), (words, f) in zip(docs, each):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    may = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(may[: len(may) * percent // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 97, 10), (3, 10_000, 35), (2, 50, 100)])
def test_same_as_plain_python(spark, longest, buckets, percent):
    rng = random.Random(longest)
    texts = [(i, sentence(rng, rng.randrange(0, 60))) for i in range(300)]
    texts += [(1000 + i, x) for i, x in enumerate(odd_texts())] + [(7, sentence(rng, 40)), (None, "one two " * 30), (None, None)]
    target = [sentence(rng, 30) for _ in range(5)] + [None, "", "Alpha BETA z" + "y" * 300]
    options = {"percent": percent, "seed": 11, "least_words": 20, "longest": longest, "buckets": buckets}
    made = resample.resample(frame(spark, texts), frame(spark, target), **options).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, made.collect()), key=key) == sorted(brute(texts, target, **options), key=key)


def test_repeated_rows_have_ranks_of_their_own(spark):
    rng = random.Random(2)
    texts = [(5, sentence(rng, 25))] * 2000 + [(i, sentence(rng, 25)) for i in range(10, 1010)]
    got = resample.resample(frame(spark, texts).repartition(13), frame(spark, [sentence(rng, 9)]), percent=50, seed=1).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == [*range(1, 1501)] and len(got) == 3000
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in drawn] == sorted((-r["score"], r["doc_id"]) for r in got)[:1500]


@pytest.mark.parametrize("rank", [1, 2, 499, 500, 998, 1000])
def test_cutoff_is_exact(spark, rank):
    rng = random.Random(rank)
    rows = [(rng.choice((1, 1, 1, rng.randrange(50))), rng.choice((None, *range(30))), i) for i in range(1000)]
    keys = spark.createDataFrame(rows, "score bigint, doc_id bigint, row bigint").repartition(7)
    got = resample.cutoff(keys, rank)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert (got["score"], got["doc_id"], got["row"]) == order[rank - 1]


def test_ids_may_be_texts(spark):
    rows = [(f"d{i % 40}", f"word{i} " * 30) for i in range(90)] + [(None, "word " * 25)]
    docs = spark.createDataFrame(rows, "name string, body string")
    got = resample.resample(docs, docs, percent=20, seed=3, doc_id="name", text="body", target_text="body").collect()
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    key = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or "")
    assert len(drawn) == 18 and [key(r) for r in drawn] == sorted(map(key, got))[:18]


def test_empty_tables(spark):
    few, none = frame(spark, ["alpha " * 30, "beta " * 30]), frame(spark, [])
    assert resample.resample(none, few, percent=10, seed=1).count() == 0
    assert [r["rank"] for r in resample.resample(few, none, percent=50, seed=1).collect()].count(1) == 1
    assert all(r["rank"] is None for r in resample.resample(few, few, percent=10, seed=1).collect())
