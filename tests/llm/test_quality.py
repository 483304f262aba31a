import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import quality, queries

from .helpers import frame, odd_texts

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    made = queries.op10_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = made.join(labels, "doc_id").toPandas()
    out = rows[rows.held_out]
    assert len(out) > 500 and rows.score.between(0, 1).all()
    assert ((out.score >= 0.7) == out.predicted).all()
    good = out[out.quality == 1]
    assert good.predicted.mean() >= 0.98 and (out.predicted == out.quality).mean() >= 0.95


def test_random_indexing_puts_like_words_together():
    rng = np.random.default_rng(1)
    # Slots 1 and 2 stand between the same words, 3 between others.
    docs = [np.array([9, 10, rng.choice([1, 2]), 11, 12, 19, 20, 3, 21, 22] * 20, np.int32) for _ in range(30)]
    v = quality.word_vectors(docs)
    assert v[1] @ v[2] > 0.9 and v[1] @ v[3] < 0.7


def test_odd_texts(spark):
    docs = frame(spark, odd_texts())
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (9, 1, None), (None, 1, 1), (77, 0, 0), (6, 5, 1), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels, F.lit(True))
    made = {r["doc_id"]: r["score"] for r in quality.quality(docs, model).collect()}
    assert len(made) == docs.count() and all(0 <= s <= 1 for s in made.values())
    assert made[0] == made[1] == made[2] and made[3] == made[5] and made[7] == made[8]
    none = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(frame(spark, []), model).count() == 0
