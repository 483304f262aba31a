import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import queries, toxicity

from .helpers import frame, odd_texts, sentence

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    made = queries.op6_toxicity_crf(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = made.join(labels, "doc_id").toPandas()
    out = rows[rows.held_out]
    assert len(out) > 500 and rows.score.between(0, 1).all() and ((out.score >= 0.5) == out.predicted).all()
    # Some labels of this table mark documents without a toxic word.
    assert out[out.toxic == 1].predicted.mean() >= 0.85
    assert out[out.toxic == 0].predicted.mean() <= 0.01


def test_marginals_same_as_enumeration():
    rng = np.random.default_rng(1)
    emission, steps = rng.normal(size=9), rng.normal(size=(2, 2))
    new = np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    pairs = np.zeros((2, 2))
    made = toxicity.marginals(emission, steps, new, pairs)
    wanted, expected = np.zeros(9), np.zeros((2, 2))
    for a, b in ((0, 4), (4, 5), (5, 9)):
        total, own, own_pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in product((0, 1), repeat=b - a):
            w = np.exp(sum(e for e, k in zip(emission[a:b], y) if k) + sum(steps[i, j] for i, j in zip(y, y[1:])))
            total += w
            own += w * np.array(y)
            for i, j in zip(y, y[1:]):
                own_pairs[i, j] += w
        wanted[a:b] = own / total
        expected += own_pairs / total
    assert np.allclose(made, wanted) and np.allclose(pairs, expected)


def trained(spark):
    rng = random.Random(8)
    clean = [sentence(rng, 12) + " all quiet here" for _ in range(60)]
    foul = [f"{sentence(rng, 6)} {('grolm', 'vrask')[i % 2]} {sentence(rng, 6)} all quiet here" for i in range(30)]
    docs = frame(spark, clean + foul)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)], "doc_id bigint, toxic int")
    return toxicity.fit(docs, labels, F.lit(True))


def test_copies_count_once():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1000, (40, 3)).astype(np.int32)
    near = words.copy()
    near[30] += 1
    other = rng.integers(0, 1000, (40, 3)).astype(np.int32)
    assert toxicity.family(words) == toxicity.family(near) != toxicity.family(other)
    assert toxicity.family(words[:2]) == toxicity.family(words[:2].copy()) and toxicity.family(words[:0]) == 0


def test_spans_are_the_words(spark):
    model = trained(spark)
    texts = ["é quiet GROLM, vrask\nall here", "all quiet here", "quiet " * 5000 + "grolm"]
    made = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, texts), model).collect()}
    cut = lambda i: [texts[i][s["start"] : s["stop"]] for s in made[i]["spans"]]
    assert cut(0) == ["GROLM, vrask"] and cut(1) == [] and cut(2) == ["grolm"]
    assert made[0]["score"] >= 0.5 > made[1]["score"] and made[2]["score"] >= 0.5


def test_odd_texts(spark):
    model = trained(spark)
    docs = frame(spark, odd_texts())
    made = {r["doc_id"]: (r["score"], r["spans"]) for r in toxicity.toxicity(docs, model).collect()}
    assert len(made) == docs.count() and all(0 <= s < 0.5 and not spans for s, spans in made.values())
    assert made[0] == made[1] == made[2] == made[4] and made[7] == made[8]
    labels = spark.createDataFrame([(3, 1), (None, 0), (7, None)], "doc_id bigint, toxic int")
    none = toxicity.fit(docs, labels, F.lit(True))
    assert none is None and {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(frame(spark, []), model).count() == 0
