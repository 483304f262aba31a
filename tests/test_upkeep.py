"""Tables that are kept up to date: what is written anew, and that the result is that of a rebuild."""

import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hearthline import schema
from hearthline.operators import retrieval
from hearthline.sources import corpus, tables


def documents(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)


def cut(df):
    return retrieval.recursive_chunks(df, "text", 40, 10)


def shown(df):
    return sorted(map(tuple, df.select("doc_id", "chunk_no", "chunk").collect()), key=repr)


def written(folder, version):
    return sum(1 for _ in Path(folder, f"rows/version={version}").glob("*.parquet"))


def test_one_changed_document_writes_its_own_chunks(spark, tmp_path):
    texts = {i: f"Document {i}. " * 12 for i in range(1000)}
    first = corpus.kept_index(spark, str(tmp_path), documents(spark, texts), "doc_id", cut)
    assert shown(first) == shown(cut(documents(spark, texts)))
    texts[417] = "Something else altogether. " * 5
    second = corpus.kept_index(spark, str(tmp_path), documents(spark, texts), "doc_id", cut)
    assert shown(second) == shown(cut(documents(spark, texts)))
    fresh = spark.read.parquet(f"{tmp_path}/rows/version=2")
    assert {r["doc_id"] for r in fresh.collect()} == {417} and second.where("version = 2").count() == fresh.count()
    again = corpus.kept_index(spark, str(tmp_path), documents(spark, texts), "doc_id", cut)
    assert corpus.last_version(spark, str(tmp_path)) == 2 and shown(again) == shown(second)


def test_new_gone_and_returning_documents(spark, tmp_path):
    states = [{1: "a b", 2: "c", None: "n"}, {1: "a b", 3: "d e"}, {1: "a b!", 2: "c", 3: "d e", None: "n"}, {}, {2: "c"}]
    for texts in states:
        made = corpus.kept_index(spark, str(tmp_path), documents(spark, texts), "doc_id", cut)
        assert shown(made) == shown(cut(documents(spark, texts)))
    assert corpus.last_version(spark, str(tmp_path)) == len(states)


def test_rows_of_one_document_and_a_lost_attempt(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id bigint, text string")
    corpus.kept_index(spark, str(tmp_path), rows, "doc_id", cut)
    # Version 2 was written but never finished.
    rows.withColumn("chunk_no", F.lit(9)).withColumnRenamed("text", "chunk").write.parquet(f"{tmp_path}/rows/version=2")
    more = rows.union(spark.createDataFrame([(1, "z")], rows.schema))
    made = corpus.kept_index(spark, str(tmp_path), more, "doc_id", cut)
    assert shown(made) == shown(cut(more))


SALES = "month date, town string, price double"


def sales(spark, rows):
    return spark.createDataFrame([(m and datetime.date(2020, m, 1), t, p) for m, t, p in rows], SALES)


def test_only_changed_months_are_written(spark, tmp_path):
    rows = [(m, t, float(m or 0)) for m in (1, 2, 3, None) for t in ("A", "B", None)]
    listed = tables.refresh_months(spark, sales(spark, rows), str(tmp_path))
    assert {r["refresh"] for r in listed.collect()} == {1}
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "rows").rglob("*.parquet")}
    rows = [r for r in rows if r[0] != 2] + [(4, "A", 9.0), (3, "B", 3.0)]
    listed = tables.refresh_months(spark, sales(spark, rows), str(tmp_path))
    months = {r["month_of"]: (r["items"], r["refresh"]) for r in listed.collect()}
    assert months == {"2020-01-01": (3, 1), "2020-03-01": (4, 2), "2020-04-01": (1, 2), "none": (3, 1)}
    kept = [p for p in before if "month_of=2020-01-01" in str(p) or "month_of=none" in str(p)]
    assert kept and all(p.stat().st_mtime_ns == before[p] for p in kept)
    held = tables.by_month(spark, str(tmp_path), ["month", "town", "price"])
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in map(str, r))
    assert sorted(map(tuple, held.collect()), key=key) == sorted(map(tuple, sales(spark, rows).collect()), key=key)
    again = tables.refresh_months(spark, sales(spark, rows), str(tmp_path))
    assert {r["refresh"] for r in again.collect()} == {1, 2}


def test_rules_are_counted(spark):
    rows = [(1, 5.0), (2, None), (3, -1.0), (None, 4.0), (None, None)]
    df = spark.createDataFrame(rows, "id int, price double")
    good, bad = schema.checked(df, {"no id": F.col("id").isNotNull(), "no price": F.col("price") > 0})
    assert [tuple(r) for r in good.collect()] == [(1, 5.0)]
    assert {r["reason"]: r["rows"] for r in bad.collect()} == {"no id": 2, "no price": 2}
    assert schema.checked(df.limit(0), {"no id": F.col("id").isNotNull()})[1].count() == 0


def test_forecasts_in_any_spelling(spark):
    rows = [(1, "10", 8.0, 12.0), (2, "ten", 8.0, 12.0), (3, "10", None, 12.0), (4, "10", -2.0, 12.0), (5, "10", 11.0, 12.0), (6, "NaN", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "step int, yhat string, lower double, upper double")
    good, bad = schema.checked_forecast(df)
    assert [tuple(r) for r in good.collect()] == [(1, 10.0, 8.0, 12.0)]
    assert {r["reason"]: r["rows"] for r in bad.collect()} == {"no mean": 2, "no band": 1, "negative": 1, "mean outside its band": 1}
    with pytest.raises(ValueError, match="mean_ci_upper"):
        schema.checked_forecast(df.drop("upper"))
    with pytest.raises(ValueError, match="missing columns"):
        schema.require(df, ["month"])
    assert schema.named_as(df, {"mean": "yhat"}).columns == ["step", "mean", "lower", "upper"]
    with pytest.raises((ValueError, PySparkException)):
        schema.named_as(df, {"mean": "nowhere"})
