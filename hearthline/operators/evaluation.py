"""Scores of answers against labelled cases.

Cases: ord (whole, unique), question, category, difficulty, expected_keywords,
expected_areas. Responses: ord, question, response. Times: ord, seconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import numbers, text, vectors
from hearthline.operators.ordering import with_position
from hearthline.schema import require

# Phrases that send a price question to the dashboard, and phrases that answer it.
REDIRECT_PHRASES = ["dashboard", "prediction", "analytics", "machine learning", "forecasting"]
AVOID_PHRASES = ["will be", "predicted price", "future price is", "estimate is"]
REDIRECT_CATEGORY = "price_prediction"


def words_of(phrases: Sequence[str]) -> Column:
    return F.array(*[F.lit(p) for p in phrases])


def answered(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Cases with their response: the last one given to the question, empty text if there is none.

    Which response is the last is found without the texts and for the asked questions only; `ord` tells the responses to a
    question apart. Texts are fetched by a join whose sizes AQE sees at runtime.
    """
    require(responses, ["ord", "question", "response"])
    asked = cases.select("question").distinct()
    given = responses.select("question", "ord").join(asked, "question", "left_semi")
    last = given.groupBy("question").agg(F.max("ord").alias("ord"))
    told = responses.select("question", "ord", "response").join(last, ["question", "ord"]).drop("ord")
    joined = cases.drop("response").join(told, "question", "left")
    return joined.withColumn("response", F.coalesce("response", F.lit("")))


def length_score(response: Column) -> Column:
    words = text.word_count(response)
    return (
        F.when(words.between(10, 100), 1.0)
        .when(words.between(5, 9) | words.between(101, 150), 0.7)
        .when(words < 5, 0.3)
        .otherwise(0.5)
    )


def with_mentions(answers: DataFrame) -> DataFrame:
    return answers.withColumns(
        {
            "keyword_score": text.share_mentioned(F.col("response"), F.col("expected_keywords")),
            "area_score": text.share_mentioned(F.col("response"), F.col("expected_areas")),
        }
    )


def response_quality(answers: DataFrame) -> DataFrame:
    """Adds keyword, area and length scores and their weighted sum `quality_score`."""
    total = F.col("keyword_score") * 0.5 + F.col("area_score") * 0.3 + F.col("length_score") * 0.2
    return (
        with_mentions(answers).withColumn("length_score", length_score(F.col("response"))).withColumn("quality_score", total)
    )


def accuracy(answers: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Adds the cosine of response and truth vectors, and the weighted sum `accuracy_score`.

    `similarity` replaces the cosine where it is known already.
    """
    if similarity is None:
        similarity = vectors.cosine(F.col("response_vector"), F.col("truth_vector"))
    total = F.col("similarity") * 0.6 + F.col("keyword_score") * 0.25 + F.col("area_score") * 0.15
    return with_mentions(answers).withColumn("similarity", similarity).withColumn("accuracy_score", total)


def redirects(answers: DataFrame) -> DataFrame:
    """Price questions only: share of redirecting phrases, absence of answering ones, `handling_score`."""
    priced = answers.where(F.col("category") == REDIRECT_CATEGORY)
    return priced.withColumns(
        {
            "redirect_score": text.share_mentioned(F.col("response"), words_of(REDIRECT_PHRASES)),
            "avoid_score": F.lit(1.0) - text.share_mentioned(F.col("response"), words_of(AVOID_PHRASES)),
        }
    ).withColumn("handling_score", F.col("redirect_score") * 0.7 + F.col("avoid_score") * 0.3)


def time_score(seconds: Column) -> Column:
    return F.when(seconds <= 2.0, 1.0).when(seconds <= 5.0, 0.8).when(seconds <= 10.0, 0.6).otherwise(0.4)


def latency(times: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean seconds (0 without any) and its score, over all times or per group."""
    found = times.groupBy(*keys).agg(
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("average_time"), F.count("seconds").alias("total_queries")
    )
    return found.withColumn("time_score", time_score(F.col("average_time")))


def timed_cases(cases: DataFrame, times: DataFrame) -> DataFrame:
    """The i-th time beside the i-th case; times beyond the last case are left out."""
    numbered = with_position(cases.select("ord", "question", "category"), [], "ord", "case_no")
    clocked = with_position(times.select("ord", "seconds"), [], "ord", "case_no").drop("ord")
    return numbered.join(clocked, "case_no").select("case_no", "question", "category", "seconds")


def mean_score(scored: DataFrame, column: str, metric: str) -> DataFrame:
    """metric, score, cases: the mean of a score column, 0 without cases."""
    return scored.agg(
        F.coalesce(F.avg(column), F.lit(0.0)).alias("score"), F.count(column).alias("cases")
    ).select(F.lit(metric).alias("metric"), "score", "cases")


def overall(metrics: Sequence[DataFrame]) -> DataFrame:
    """The metric rows and one more, `overall`: the mean of the scores there are."""
    rows = reduce(DataFrame.unionByName, [m.select("metric", "score") for m in metrics])
    total = rows.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score")).select(F.lit("overall").alias("metric"), "score")
    return rows.unionByName(total)


def result_table(cases: DataFrame, accurate: DataFrame, quality: DataFrame) -> DataFrame:
    """One numbered row per case, ready for a pipe table; N/A where a score is missing."""
    numbered = with_position(cases.select("ord", "question", "category"), [], "ord", "case_no")
    rows = numbered.join(
        accurate.select("ord", "response", F.col("accuracy_score").alias("_a")), "ord", "left"
    ).join(quality.select("ord", F.col("quality_score").alias("_q")), "ord", "left")
    return rows.select(
        "case_no",
        text.table_cell(F.col("question"), keep_lines=True).alias("question"),
        text.title(F.col("category")).alias("category"),
        text.table_cell(F.coalesce("response", F.lit("No response recorded"))).alias("answer"),
        numbers.fixed(F.col("_a"), 3).alias("ground_truth_score"),
        numbers.fixed(F.col("_q"), 3).alias("response_quality_score"),
        numbers.fixed((F.col("_a") + F.col("_q")) / 2.0, 3).alias("overall_performance"),
    )


def category_listing(cases: DataFrame) -> DataFrame:
    """category, cases, first_ord, place, question: the questions under each category, in case order.

    A category can hold most of the cases, so its list is rows, not an array.
    """
    listed = cases.select("ord", "question", "category")
    placed = with_position(listed, ["category"], "ord", "place", total="cases", first="first_ord", null_keys=True)
    return placed.select(text.title(F.col("category")).alias("category"), "cases", "first_ord", "place", "question")


def sample(cases: DataFrame, rows: int = 2, seed: int = 1) -> DataFrame:
    """Up to `rows` cases, scored or not, picked by a hash of seed and ord: random, yet the same on every run."""
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("ord").cast("string")))
    picked = cases.withColumn("_draw", draw).orderBy("_draw", "ord").limit(rows).drop("_draw")
    return picked.withColumn("question_start", F.substring("question", 1, 50))
