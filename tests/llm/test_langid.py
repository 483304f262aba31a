from pyspark.sql import functions as F

from hearthline.llm import langid, queries
from hearthline.llm.common import fold
from hearthline.llm.labelled import first_texts

from .helpers import frame, odd_texts

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    made = queries.op3_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = made.join(docs, "doc_id").toPandas()
    out = rows[rows.held_out]
    assert len(rows) == 1000 and 200 < len(out) < 500
    assert (out.lang == out.lang_pred).mean() >= 0.99 and rows.score.between(0, 1).all()
    assert not out.rejected.any()


def test_other_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    strange = ["Это совсем другой язык, которого модель не знает " * 5, "これは日本語の文章です。" * 10, "zxq jqxz qqzx xjq zzqx " * 20]
    made = langid.identify(frame(spark, strange), model).collect()
    assert all(r["rejected"] for r in made)
    kept = langid.recognised(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = langid.fit(docs, fold(F.col("doc_id"), 3) != 1)
    changed = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("").alias("source"))
    key = lambda df: sorted((r["lang_pred"], r["score"], r["rejected"]) for r in df.collect())
    assert key(langid.identify(docs, model)) == key(langid.identify(changed, model))


def test_odd_texts(spark):
    docs = frame(spark, odd_texts())
    model = langid.fit(docs, F.lit(True))
    made = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(docs, model).collect()}
    assert {i for i, (p, _) in made.items() if p == "und"} == {0, 1, 2, 4}
    assert all(made[i][1] for i in (0, 1, 2, 4)) and made[7] == made[8] == ("en", False)
    nothing = langid.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(frame(spark, []), model).count() == 0
    signs = langid.identify(frame(spark, ["— … “”", "123", "ß"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in signs] == ["und", "und", "en"]


def test_long_text_is_seen_whole(spark):
    import numpy as np

    from hearthline.llm.common import text_bytes
    import pyarrow as pa

    text = "abc déf " * 400_000
    data, at, _ = text_bytes(pa.array([text]))
    [(_, _, _, _, many)] = list(langid.grams(data, at, 64))
    data, at, _ = text_bytes(pa.array(["abc déf "]))
    [(_, _, _, _, once)] = list(langid.grams(data, at, 64))
    assert abs(int(np.sum(many)) - 400_000 * int(np.sum(once))) <= 400_000 * 3


def test_every_language_is_learned_and_repeats_fill_no_sample(spark):
    many = 1001
    rows = [(i, f"word{i} " * 3, f"l{i:04d}") for i in range(many)] + [(5, "word5 word5 word5 ", "l0005")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = first_texts(docs, "lang", 1)
    assert sample.count() == many and sample.select("lang").distinct().count() == many
    assert first_texts(docs.withColumn("text", F.concat("text", F.expr("uuid()"))), "lang", 10).where("lang = 'l0005'").count() == 10
    assert len(langid.fit(docs, F.lit(True), per_language=1, centroids=1).languages) == many
