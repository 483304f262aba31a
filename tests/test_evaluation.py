import pytest
from pyspark.sql import functions as F

from hearthline.operators import evaluation

CASES = "ord bigint, question string, category string, difficulty string, expected_keywords array<string>, expected_areas array<string>"
FILLER = "one two three four five six seven eight nine ten"

# Per case the category, the answer's found and missing keywords, its areas, the
# cosine of answer and truth, and the published quality and accuracy scores.
GOLDEN = [
    ("area_info", ["nus", "connectivity", "mature"], [], ["clementi"], 0.873, 1.000, 0.924),
    ("area_info", ["amenities", "mrt", "connectivity"], [], ["tampines"], 0.860, 1.000, 0.916),
    ("price_info", ["sgd", "price", "affordable"], [], ["yishun"], 0.918, 1.000, 0.951),
    ("price_prediction", ["dashboard", "prediction", "analytics", "machine learning"], [], [], 0.843, 1.000, 0.906),
    ("price_prediction", ["dashboard", "prediction", "analytics"], [], [], 0.718, 1.000, 0.831),
    ("comparison", [], ["price", "pros", "cons"], ["punggol", "toa payoh"], 0.722, 0.500, 0.583),
    ("unknown_area", ["don't know"], ["no information", "not available"], [], 0.883, 0.667, 0.763),
    ("general", ["singapore"], ["assistant", "help", "housing"], [], 0.904, 0.625, 0.755),
]


@pytest.fixture()
def golden(spark):
    cases, responses = [], []
    for i, (category, found, missing, areas, cosine, _, _) in enumerate(GOLDEN, 1):
        cases.append((i, f"question {i}", category, "easy", [k.upper() for k in found] + missing, [a.title() for a in areas]))
        # "pricier" does not contain "price".
        said = " ".join([FILLER, "pricier", *found, *areas, "machine learning forecasting" if category == "price_prediction" else ""])
        responses.append((i, f"question {i}", said, cosine))
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(responses, "ord bigint, question string, response string, cosine double")


def test_golden_scores(spark, golden):
    cases, responses = golden
    answers = evaluation.answered(cases, responses).join(responses.select("ord", "cosine"), "ord")
    answers = answers.withColumn("response", F.when(F.col("ord") == 5, F.concat("response", F.lit(" machine learning"))).otherwise(F.col("response")))
    quality, accurate = evaluation.response_quality(answers), evaluation.accuracy(answers, F.col("cosine"))
    assert [round(r["quality_score"], 3) for r in quality.orderBy("ord").collect()] == [g[5] for g in GOLDEN]
    assert [r["accuracy_score"] for r in accurate.orderBy("ord").collect()] == pytest.approx([g[6] for g in GOLDEN], abs=6e-4)
    handled = evaluation.redirects(answers)
    assert [(r["redirect_score"], r["avoid_score"], r["handling_score"]) for r in handled.collect()] == [(1.0, 1.0, 1.0)] * 2
    clock = evaluation.latency(spark.createDataFrame([(i, 2.58) for i in range(8)], "ord bigint, seconds double"))
    metrics = [
        evaluation.mean_score(accurate, "accuracy_score", "ground_truth_accuracy"),
        evaluation.mean_score(quality, "quality_score", "response_quality"),
        evaluation.mean_score(handled, "handling_score", "price_prediction_handling"),
        clock.select(F.lit("response_time").alias("metric"), F.col("time_score").alias("score")),
    ]
    made = {r["metric"]: r["score"] for r in evaluation.overall(metrics).collect()}
    published = {
        "ground_truth_accuracy": 0.829,
        "response_quality": 0.849,
        "price_prediction_handling": 1.0,
        "response_time": 0.8,
        "overall": 0.869,
    }
    assert made == pytest.approx(published, abs=1e-3)
    table = evaluation.result_table(cases, accurate, quality.where("ord <> 8")).orderBy("case_no").collect()
    assert table[5]["category"] == "Comparison" and table[5]["response_quality_score"] == "0.500"
    assert (table[7]["response_quality_score"], table[7]["overall_performance"]) == ("N/A", "N/A")
    assert [r["case_no"] for r in table] == list(range(1, 9))


@pytest.mark.parametrize("words,score", [(0, 0.3), (4, 0.3), (5, 0.7), (9, 0.7), (10, 1.0), (100, 1.0), (101, 0.7), (150, 0.7), (151, 0.5)])
def test_length_score(spark, words, score):
    text = " ".join(["w"] * words)
    assert spark.range(1).select(evaluation.length_score(F.lit(text)).alias("s")).first()["s"] == score


def test_missing_and_repeated_answers(spark):
    cases = spark.createDataFrame([(1, "a", "c", "e", [], []), (2, "b", "c", "e", ["x"], [])], CASES)
    said = spark.createDataFrame([(1, "a", "first"), (2, "a", "last")], "ord bigint, question string, response string")
    made = {r["ord"]: r for r in evaluation.response_quality(evaluation.answered(cases, said)).collect()}
    assert made[1]["response"] == "last" and made[1]["keyword_score"] == 1.0
    assert made[2]["response"] == "" and made[2]["quality_score"] == pytest.approx(0.3 + 0.06)


def test_times_beyond_the_cases_are_left_out(spark):
    cases = spark.createDataFrame([(10, "a", "c", "e", [], []), (30, "b", "c", "e", [], [])], CASES)
    times = spark.createDataFrame([(5, 1.0), (6, 2.0), (7, 9.0)], "ord bigint, seconds double")
    made = sorted(tuple(r) for r in evaluation.timed_cases(cases, times).collect())
    assert made == [(1, "a", "c", 1.0), (2, "b", "c", 2.0)]
    assert evaluation.latency(times).first()["average_time"] == 4.0


@pytest.mark.parametrize("mean,score", [(0.0, 1.0), (2.0, 1.0), (2.01, 0.8), (5.0, 0.8), (10.0, 0.6), (10.1, 0.4)])
def test_time_score(spark, mean, score):
    assert spark.range(1).select(evaluation.time_score(F.lit(mean)).alias("s")).first()["s"] == score


def test_no_times_and_no_cases(spark):
    row = evaluation.latency(spark.createDataFrame([], "ord bigint, seconds double")).first()
    assert (row["average_time"], row["total_queries"], row["time_score"]) == (0.0, 0, 1.0)
    empty = evaluation.mean_score(spark.createDataFrame([], "s double"), "s", "m").first()
    assert (empty["score"], empty["cases"]) == (0.0, 0)


def test_category_listing(spark):
    cases = spark.createDataFrame([(i, f"q{i}", "price_info" if i % 2 else "general", "e", [], []) for i in range(5)], CASES)
    unknown = spark.createDataFrame([(9, "q9", None, "e", [], [])], CASES)
    found = [tuple(r) for r in evaluation.category_listing(cases.unionByName(unknown)).collect()]
    assert (None, 1, 9, 1, "q9") in found
    made = sorted(r for r in found if r[0])
    assert made == [
        ("General", 3, 0, 1, "q0"),
        ("General", 3, 0, 2, "q2"),
        ("General", 3, 0, 3, "q4"),
        ("Price Info", 2, 1, 1, "q1"),
        ("Price Info", 2, 1, 2, "q3"),
    ]


def test_sample(spark):
    df = spark.range(20).select(F.col("id").alias("ord"), F.repeat(F.lit("q"), 60).alias("question"))
    one = [r["ord"] for r in evaluation.sample(df, seed=1).collect()]
    assert one == [r["ord"] for r in evaluation.sample(df.repartition(7), seed=1).collect()] and len(one) == 2
    assert len(evaluation.sample(df.limit(1)).collect()) == 1
    assert evaluation.sample(df).first()["question_start"] == "q" * 50


def test_cells_for_a_pipe_table(spark):
    cases = spark.createDataFrame([(1, "a|b", "price_info", "e", [], [])], CASES)
    scored = cases.withColumns({"response": F.lit("x\ny|z"), "accuracy_score": F.lit(0.5), "quality_score": F.lit(0.25)})
    row = evaluation.result_table(cases, scored, scored).first()
    assert (row["question"], row["answer"], row["overall_performance"]) == ("a\\|b", "x y\\|z", "0.375")
