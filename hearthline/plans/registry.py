"""The named queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import dates, features, numbers, text, vectors
from hearthline.operators import conversation, evaluation, forecast, market, retrieval, scoring, segment
from hearthline.operators.distribution import histogram
from hearthline.operators.segment import SEGMENT
from hearthline.plans import tables
from hearthline.plans.tables import folder_for, sales, table
from hearthline.schema import DISTANCES, checked_forecast
from hearthline.runtime import durable, side_by_side
from hearthline.sources import corpus
from hearthline.sources import tables as stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASE_YEAR = 1997
RATE_COLUMNS = ["town", "flat_type", "month", "resale_price", "floor_area_sqm"]
REQUEST_COLUMNS = ["town", "flat_type", "floor_area_sqm", "remaining_lease"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def settled(c: Column, digits: int = 6) -> Column:
    """Rounds with its border away from round numbers, so engines that add in another order agree."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.4137) / scale


def with_settled(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: settled(F.col(n), digits) for n in names})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.usual_requests(sales(spark, sf_dir, *REQUEST_COLUMNS))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.monthly_rates(sales(spark, sf_dir, *RATE_COLUMNS))


def rates_and_requests(spark: SparkSession, sf_dir: str, keep: bool = False) -> list[DataFrame]:
    """Both, stored if a query uses them more than once."""
    kept = durable if keep else lambda df: df
    tables.sales_table(spark, sf_dir)
    return side_by_side(
        spark, lambda: kept(rates(spark, sf_dir)), lambda: kept(requests(spark, sf_dir))
    )


# ---- market overview -------------------------------------------------------------------


@query
def kpi_snapshot(spark, sf_dir):
    rows = sales(spark, sf_dir, "month", "resale_price", "region", "flat_type")
    return with_settled(
        market.kpi_snapshot(rows, BASE_YEAR),
        6,
        "median_price",
        "prev_median_price",
        "median_price_change_pct",
        "transactions_change_pct",
        "price_index",
        "index_vs_base_pct",
        "top_region_median",
    )


@query
def trend_monthly(spark, sf_dir):
    return with_settled(market.trend(sales(spark, sf_dir, "month", "resale_price"), aggregate="mean"), 6, "value")


@query
def trend_by_region(spark, sf_dir):
    rows = sales(spark, sf_dir, "month", "region", "resale_price")
    return with_settled(market.trend(rows, group_by="region", aggregate="median"), 8, "value")


@query
def trend_by_flat_type_range(spark, sf_dir):
    rows = sales(spark, sf_dir, "month", "flat_type", "price_per_sqm")
    return with_settled(
        market.trend(rows, "price_per_sqm", "flat_type", "max", start="1996-01-01", end="1998-12-01"), 8, "value"
    )


def _trend_sets(spark, sf_dir, measure):
    rows = sales(spark, sf_dir, "month", "region", "flat_type", "flat_model", measure)
    return with_settled(market.trend_sets(rows, measure), 6, "mean", "median", "min", "max")


@query
def trend_all_sets(spark, sf_dir):
    return _trend_sets(spark, sf_dir, "resale_price")


@query
def trend_all_sets_per_sqm(spark, sf_dir):
    return _trend_sets(spark, sf_dir, "price_per_sqm")


@query
def flat_distribution(spark, sf_dir):
    return market.composition(sales(spark, sf_dir, "flat_type"))


def _ranking(spark, sf_dir, measure):
    dimensions = ["flat_type", "region", "town", "flat_model", "district_number"]
    rows = sales(spark, sf_dir, *dimensions, measure)
    ranked = with_settled(market.ranking(rows, measure, dimensions), 6, "mean", "median")
    return ranked.withColumn("title", text.title(F.col("dimension")))


@query
def price_ranking(spark, sf_dir):
    return _ranking(spark, sf_dir, "resale_price")


@query
def price_ranking_per_sqm(spark, sf_dir):
    return _ranking(spark, sf_dir, "price_per_sqm")


LINE = ["slope", "intercept", "x_min", "x_max", "y_at_min", "y_at_max"]


@query
def ols_by_group(spark, sf_dir):
    rows = sales(spark, sf_dir, "region", "flat_type", "town", "floor_area_sqm", "resale_price")
    return with_settled(with_settled(market.regression(rows, "floor_area_sqm"), 4, *LINE), 8, "r2")


@query
def ols_by_group_per_sqm(spark, sf_dir):
    rows = sales(spark, sf_dir, "region", "flat_type", "town", "remaining_lease", "price_per_sqm")
    return with_settled(with_settled(market.regression(rows, "remaining_lease", "price_per_sqm"), 4, *LINE), 8, "r2")


@query
def ols_global(spark, sf_dir):
    rows = sales(spark, sf_dir, *market.EXPLANATORY, "resale_price")
    return with_settled(with_settled(market.regression_all(rows), 4, *LINE), 8, "r2")


@query
def ols_grid(spark, sf_dir):
    """Every explanatory variable with either price, for the market, the regions, the flat types and the towns."""
    rows = sales(spark, sf_dir, *market.EXPLANATORY, "resale_price", "price_per_sqm", "region", "flat_type", "town")
    return with_settled(with_settled(market.regression_grid(rows), 4, *LINE), 8, "r2")


@query
def map_extract(spark, sf_dir):
    return with_settled(market.map_extract(sales(spark, sf_dir, *market.MAP_COLUMNS)), 6, "resale_price", "price_norm")


@query
def heat_grid(spark, sf_dir):
    return with_settled(market.heat_grid(sales(spark, sf_dir, "latitude", "longitude", "resale_price")), 2, "weight")


@query
def town_map(spark, sf_dir):
    columns = ["town", "month", "resale_price", "price_per_sqm", "flat_type", "floor_area_sqm", "remaining_lease"]
    rows = sales(spark, sf_dir, *columns, "latitude", "longitude", *DISTANCES)
    return with_settled(market.town_map(rows), 6, "latitude", "longitude", "centre_latitude", "centre_longitude")


@query
def town_histogram(spark, sf_dir):
    bins = histogram(sales(spark, sf_dir, "town", "resale_price"), ["town"], "resale_price")
    return with_settled(bins, 6, "bin_start", "bin_end")


# ---- labels and features ---------------------------------------------------------------


@query
def label_normalised(spark, sf_dir):
    kinds = sales(spark, sf_dir, "flat_type").distinct().na.drop()
    label = text.label(F.col("flat_type"))
    return kinds.select(
        "flat_type",
        label.alias("label"),
        text.feature_name(label).alias("feature"),
        text.label_of_feature(text.feature_name(label)).alias("label_of_feature"),
        text.loose_key(F.col("flat_type")).alias("loose_key"),
        text.file_key(F.col("flat_type")).alias("file_key"),
    ).orderBy("label")


@query
def lenient_parse(spark, sf_dir):
    shown = F.date_format("ts", "yyyy-MM-dd")
    key = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id",
        dates.strict_date(shown).alias("strict_date"),
        dates.lenient_date(shown).alias("lenient_date"),
        dates.lenient_date(F.col("event_type")).alias("no_date"),
        numbers.lenient_number(key).alias("number"),
        numbers.lenient_number(F.col("event_type")).alias("no_number"),
    )


def _feature_columns(spark, sf_dir):
    """Flat type and region column names, found in the data."""
    kinds = sales(spark, sf_dir, "flat_type")
    places = table(spark, sf_dir, "region")
    flat = features.categories(kinds, text.feature_name(text.label(F.col("flat_type"))))
    return flat, features.categories(places, features.region_feature(F.col("r_name")))


@query
def onehot_features(spark, sf_dir):
    flat, regions = _feature_columns(spark, sf_dir)
    rows = sales(spark, sf_dir, "month", "town", "flat_type", "region", "resale_price")
    made = features.sale_features(rows, flat, regions, features.region_feature(F.col("region")))
    return made.withColumn("mapped_region", features.town_region(F.col("town")))


@query
def town_region_features(spark, sf_dir):
    """Region flags through the fixed lookup: the n-th nation stands for the n-th town of the lookup."""
    named = F.array(*[F.lit(t) for t in sorted(features.TOWN_REGION)])
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("town"), F.element_at(named, (F.col("n_nationkey") + 1).cast("int")).alias("listed_town")
    )
    rows = sales(spark, sf_dir, "month", "town", "flat_type", "resale_price").join(nations, "town", "left").drop("town")
    flat, _ = _feature_columns(spark, sf_dir)
    region = features.town_region(F.col("listed_town"))
    made = features.sale_features(rows, flat, sorted(set(features.TOWN_REGION.values())), region)
    return made.withColumn("mapped_region", region)


def _town_regions(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("town"), F.col("r_name").alias("region")
    )


# A model's feature list: spaces in names, and one feature no request has.
MODEL_FEATURES = [
    "floor_area_sqm",
    "remaining_lease",
    "nearest_mrt_distance_km",
    "flat_type_1 URGENT",
    "flat_type_4 NOT SPECIFIED",
    "flat_type_9 UNKNOWN",
    "region_Asia",
    "region_Middle East",
]


@query
def feature_align(spark, sf_dir):
    flat, regions = _feature_columns(spark, sf_dir)
    asked = requests(spark, sf_dir).join(_town_regions(spark, sf_dir), "town", "left")
    rows = features.request_features(asked, flat, regions, features.region_feature(F.col("region")), keep=SEGMENT)
    return features.aligned(rows, MODEL_FEATURES, keep=SEGMENT)


# ---- segments --------------------------------------------------------------------------


@query
def size_bounds(spark, sf_dir):
    return with_settled(
        segment.size_bounds(sales(spark, sf_dir, "town", "flat_type", "floor_area_sqm")), 6, "default_size"
    )


@query
def district_mode(spark, sf_dir):
    return segment.usual_district(sales(spark, sf_dir, "town", "district_number"))


@query
def segment_history(spark, sf_dir):
    found = segment.segment_history(*rates_and_requests(spark, sf_dir))
    return with_settled(found, 6, "price_per_sqm", "price")


def _recent_history(spark, sf_dir):
    tables.sales_table(spark, sf_dir)
    monthly, asked = side_by_side(
        spark,
        lambda: segment.recent_rates(sales(spark, sf_dir, *RATE_COLUMNS)),
        lambda: requests(spark, sf_dir),
    )
    return segment.segment_history(monthly, asked).select(*SEGMENT, "month", F.col("price").alias("historical_price"))


@query
def history_24m(spark, sf_dir):
    return with_settled(_recent_history(spark, sf_dir), 6, "historical_price")


def _comparables(spark, sf_dir):
    rows = sales(spark, sf_dir, "town", "flat_type", *segment.COMPARABLE_COLUMNS)
    return segment.comparables(rows, requests(spark, sf_dir))


@query
def comparables(spark, sf_dir):
    return with_settled(_comparables(spark, sf_dir), 6, "resale_price", *DISTANCES)


@query
def comparables_map(spark, sf_dir):
    rows = sales(spark, sf_dir, "town", "flat_type", *segment.COMPARABLE_COLUMNS, "price_per_sqm", "latitude", "longitude")
    return with_settled(segment.comparables_map(rows, requests(spark, sf_dir)), 6, "latitude", "longitude")


@query
def comparables_report(spark, sf_dir):
    return segment.shown_comparables(_comparables(spark, sf_dir))


# ---- forecast --------------------------------------------------------------------------

# A model's input columns: two spellings of flat types, and none for "5-LOW".
INPUT_COLUMNS = [
    "district_number",
    "flat_type_1_URGENT",
    "flat_type_2 HIGH",
    "flat_type_3-MEDIUM",
    "flat_type_4_NOT_SPECIFIED",
]


@query
def forecast_exog(spark, sf_dir):
    rows = sales(spark, sf_dir, *RATE_COLUMNS, "district_number")
    return forecast.forecast_inputs(rows, requests(spark, sf_dir), INPUT_COLUMNS)


def _forecast(spark, sf_dir):
    return forecast.segment_forecast(*rates_and_requests(spark, sf_dir))


BAND = ["predicted_mean", "mean_ci_lower", "mean_ci_upper"]


@query
def segment_forecast(spark, sf_dir):
    return with_settled(_forecast(spark, sf_dir), 2, *BAND)


def _history_and_forecast(spark, sf_dir):
    monthly, asked = rates_and_requests(spark, sf_dir, keep=True)
    return segment.segment_history(monthly, asked), forecast.segment_forecast(monthly, asked)


@query
def forecast_series(spark, sf_dir):
    series = forecast.chart_series(*_history_and_forecast(spark, sf_dir))
    return with_settled(series, 2, "price", "ci_lower", "ci_upper", "y_low", "y_high")


@query
def forecast_headline(spark, sf_dir):
    found = forecast.headline(*rates_and_requests(spark, sf_dir))
    return with_settled(found, 2, "last_price", "forecast_price", "change_pct")


@query
def price_scoring(spark, sf_dir):
    flat, regions = _feature_columns(spark, sf_dir)
    region = features.region_feature(F.col("region"))
    rows = sales(spark, sf_dir, "price_per_sqm", "flat_type", "region", *features.NUMERIC_FEATURES)
    model = scoring.train(rows, flat, regions, region)
    asked = requests(spark, sf_dir).join(_town_regions(spark, sf_dir), "town", "left")
    return scoring.score(asked, model, flat, regions, region, keep=SEGMENT)


@query
def price_scoring_checked(spark, sf_dir):
    """Of every priced request: whether its price is its rate times its area, and its rate one that sales may average to."""
    rates_ = sales(spark, sf_dir, "price_per_sqm").agg(F.struct(F.min("price_per_sqm").alias("low"), F.max("price_per_sqm").alias("high"))).scalar()
    rate, area = F.col("predicted_rate"), F.col("floor_area_sqm")
    return price_scoring(spark, sf_dir).select(
        *SEGMENT,
        area,
        F.coalesce(F.col("predicted_price") == rate * area, F.lit(False)).alias("consistent"),
        F.coalesce(rate.between(rates_["low"], rates_["high"]), F.lit(False)).alias("within_range"),
    )


def _damaged_forecast(spark, sf_dir):
    """Forecasts in other spellings of the columns; those of the first months of a year have a fault each."""
    month = F.month("month")
    mean, low, high = (F.col(c) for c in BAND)
    # Stored: the rules look at each value several times, and what makes them is long.
    ahead = durable(forecast.accepted(_forecast(spark, sf_dir)).select(*SEGMENT, "month", *BAND))
    return ahead.select(
        *SEGMENT,
        "month",
        F.when(month != 1, mean).alias("yhat"),
        F.when(month == 2, high + 1.0).when(month == 3, -1.0).otherwise(low).alias("lower"),
        F.when(month != 4, high).alias("upper"),
    )


@query
def forecast_accepted(spark, sf_dir):
    """The sound rows of a forecast, in the usual spelling of its columns."""
    accepted, _ = checked_forecast(_damaged_forecast(spark, sf_dir))
    return with_settled(accepted, 2, "mean", "mean_ci_lower", "mean_ci_upper")


@query
def forecast_rejects(spark, sf_dir):
    """Why rows of a forecast are refused, and how many."""
    return checked_forecast(_damaged_forecast(spark, sf_dir))[1]


# ---- documents and retrieval -----------------------------------------------------------


@query
def doc_assembly(spark, sf_dir):
    made = retrieval.assemble(tables.area_profiles(spark, sf_dir))
    return made.select(
        "doc_id", "page_content", F.col("metadata")["Area"].alias("area"), F.col("metadata")["Source"].alias("source")
    )


@query
def doc_assembly_availability(spark, sf_dir):
    made = retrieval.assemble(tables.area_profiles(spark, sf_dir), with_availability=True)
    return made.select("doc_id", "page_content", F.col("metadata")["Area"].alias("area"))


@query
def doc_chunks(spark, sf_dir):
    chunks = retrieval.stride_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


@query
def doc_chunks_recursive(spark, sf_dir):
    documents = retrieval.assemble(tables.area_profiles(spark, sf_dir))
    return retrieval.recursive_chunks(documents.select("doc_id", "source", "page_content"), "page_content")


@query
def area_list(spark, sf_dir):
    return corpus.area_names(tables.area_profiles(spark, sf_dir))


@query
def vector_normalise(spark, sf_dir):
    scaled = retrieval.normalised(table(spark, sf_dir, "embeddings"), "embedding")
    return scaled.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", F.col("i").cast("bigint").alias("i"), settled(F.col("x"), 6).alias("x")
    )


def _top2(spark, sf_dir):
    """Per label, the two vectors closest to the mean vector of the label."""
    store = table(spark, sf_dir, "embeddings")
    topics = retrieval.mean_vectors(store, "label", "embedding")
    return retrieval.nearest(store.select("vec_id", "embedding"), topics, "vec_id", "label", k=2)


@query
def knn_top2(spark, sf_dir):
    found = with_settled(_top2(spark, sf_dir), 6, "similarity")
    return found.withColumns({"rank": F.col("rank").cast("bigint"), "label": F.col("label").cast("bigint")})


@query
def retrieval_context(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    found = _top2(spark, sf_dir).join(documents, "vec_id", "left")
    # A vector without a document keeps its place, with empty text.
    nothing = F.lit("")
    metadata = retrieval.shown_metadata(
        {"Area": F.concat(F.lit("Area "), F.col("vec_id").cast("string")), "Source": F.coalesce("source", nothing)}
    )
    made = retrieval.context(found, "label", metadata, F.coalesce("text", nothing))
    return made.withColumn("label", F.col("label").cast("bigint"))


@query
def corpus_fingerprint(spark, sf_dir):
    return corpus.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"], ["source"])


def _documents_with_vectors(spark, sf_dir):
    """doc_id, source, text, and the document's unit vector, or none if it has no vector."""
    scaled = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), vectors.unit(F.col("embedding")).alias("embedding")
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(scaled, "doc_id", "left")


def _index(spark, sf_dir, documents, name):
    """The stored chunks of the documents, brought up to date; chunks of another cut are another index."""
    folder = folder_for(spark, sf_dir, f"{name}/{retrieval.CHUNK_SIZE}-{retrieval.CHUNK_OVERLAP}")
    return corpus.kept_index(spark, folder, documents, "doc_id", lambda some: retrieval.recursive_chunks(some, "text"))


@query
def index_write(spark, sf_dir):
    return _index(spark, sf_dir, _documents_with_vectors(spark, sf_dir), "index").select(
        "doc_id",
        "source",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        "chunk",
        F.size("embedding").cast("bigint").alias("dimensions"),
    )


@query
def index_update(spark, sf_dir):
    """An index of other documents brought up to date: every tenth text differed, every eleventh document is new, and one is gone
    for every thirteenth. The version tells which documents were cut anew."""
    now = _documents_with_vectors(spark, sf_dir)
    differed = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Once "), "text")).otherwise(F.col("text"))
    before = now.where("doc_id % 11 <> 0").withColumn("text", differed)
    gone = now.where("doc_id % 13 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    name = f"index_update/{uuid4().hex}"
    _index(spark, sf_dir, before.union(gone), name)
    return _index(spark, sf_dir, now, name).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk", F.col("version").cast("bigint").alias("version")
    )


@query
def retrieval_chunks(spark, sf_dir):
    """Per label, the text of the two stored chunks closest to the label's mean vector; of one document's, the first ones."""
    chunk_id = F.struct("doc_id", "chunk_no").alias("chunk_id")
    index = _index(spark, sf_dir, _documents_with_vectors(spark, sf_dir), "index").where(F.col("embedding").isNotNull())
    index = index.select(chunk_id, "doc_id", "source", "chunk", "embedding")
    topics = retrieval.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    # Stored: the few chunks found are known to be few, so the index's texts are not shuffled to meet them.
    found = durable(retrieval.nearest(index.select("chunk_id", "embedding"), topics, "chunk_id", "label", k=2))
    shown = {"Area": F.concat(F.lit("Area "), F.col("doc_id").cast("string")), "Source": F.col("source")}
    texts = found.join(index.drop("embedding"), "chunk_id")
    made = retrieval.context(texts, "label", retrieval.shown_metadata(shown), F.col("chunk"))
    return made.withColumn("label", F.col("label").cast("bigint"))


# ---- conversations ---------------------------------------------------------------------


@query
def history_export(spark, sf_dir):
    return conversation.history(tables.messages(spark, sf_dir))


@query
def history_lists(spark, sf_dir):
    """The same as the entries of one list per conversation, shown as lines."""
    lists = conversation.history_lists(tables.messages(spark, sf_dir))
    line = F.concat(F.col("entry.type"), F.lit(": "), F.col("entry.content"))
    return lists.select("conv_id", "messages", "place", line.alias("line"))


@query
def answer_context(spark, sf_dir):
    return conversation.answer_context(tables.messages(spark, sf_dir))


@query
def conversation_append(spark, sf_dir):
    """Each conversation's last message is said once more at its end; then the latest message is read."""
    spoken = tables.messages(spark, sf_dir)
    longer = conversation.append(spoken, conversation.latest_message(spoken))
    return conversation.latest_message(longer)


# ---- evaluation ------------------------------------------------------------------------


@query
def keyword_area_scores(spark, sf_dir):
    scored = evaluation.with_mentions(tables.cases(spark, sf_dir))
    return with_settled(
        scored.select("ord", "keyword_score", "area_score", text.word_count(F.col("response")).cast("bigint").alias("words")),
        6,
        "keyword_score",
        "area_score",
    )


def _quality(spark, sf_dir):
    answers = evaluation.answered(tables.cases(spark, sf_dir), tables.conversation_responses(spark, sf_dir))
    return evaluation.response_quality(answers)


@query
def response_quality(spark, sf_dir):
    scores = ["keyword_score", "area_score", "length_score", "quality_score"]
    return with_settled(_quality(spark, sf_dir).select("ord", "question", "category", "difficulty", *scores), 6, *scores)


def _accuracy(spark, sf_dir):
    """Documents against the mean vector of their vector's label; null similarity and score without a vector."""
    store = table(spark, sf_dir, "embeddings")
    truth = durable(retrieval.mean_vectors(store, "label", "embedding")).withColumnRenamed("embedding", "truth_vector")
    paired = store.join(truth, "label").select(
        F.col("vec_id").alias("ord"), F.col("embedding").alias("response_vector"), "truth_vector"
    )
    cases = tables.cases(spark, sf_dir).join(paired, "ord", "left")
    return evaluation.accuracy(evaluation.answered(cases, tables.document_responses(spark, sf_dir)))


@query
def accuracy_scores(spark, sf_dir):
    scores = ["similarity", "keyword_score", "area_score", "accuracy_score"]
    return with_settled(_accuracy(spark, sf_dir).select("ord", "question", *scores), 6, *scores)


def _redirects(spark, sf_dir):
    priced = tables.cases(spark, sf_dir).where(F.col("category") == evaluation.REDIRECT_CATEGORY)
    return evaluation.redirects(evaluation.answered(priced, tables.document_responses(spark, sf_dir)))


@query
def redirect_scores(spark, sf_dir):
    scores = ["redirect_score", "avoid_score", "handling_score"]
    return with_settled(_redirects(spark, sf_dir).select("ord", "question", *scores), 6, *scores)


@query
def latency_score(spark, sf_dir):
    return with_settled(evaluation.latency(tables.times(spark, sf_dir), ["event_type"]), 6, "average_time")


@query
def timed_cases(spark, sf_dir):
    return evaluation.timed_cases(tables.cases(spark, sf_dir), tables.times(spark, sf_dir))


def _overall(spark, sf_dir):
    clock = evaluation.latency(tables.times(spark, sf_dir)).select(
        F.lit("response_time").alias("metric"), F.col("time_score").alias("score"), F.col("total_queries").alias("cases")
    )
    return evaluation.overall(
        [
            evaluation.mean_score(_accuracy(spark, sf_dir), "accuracy_score", "ground_truth_accuracy"),
            evaluation.mean_score(_quality(spark, sf_dir), "quality_score", "response_quality"),
            evaluation.mean_score(_redirects(spark, sf_dir), "handling_score", "price_prediction_handling"),
            clock,
        ]
    )


@query
def overall_scores(spark, sf_dir):
    return with_settled(_overall(spark, sf_dir), 6, "score")


@query
def eval_table(spark, sf_dir):
    return evaluation.result_table(
        tables.cases(spark, sf_dir), _accuracy(spark, sf_dir), _quality(spark, sf_dir)
    )


@query
def category_listing(spark, sf_dir):
    return evaluation.category_listing(tables.cases(spark, sf_dir))


@query
def eval_sample(spark, sf_dir):
    # Drawn before anything is scored, so that two cases' texts are read and not the corpus.
    picked = durable(evaluation.sample(tables.cases(spark, sf_dir).drop("response"), rows=2, seed=1))
    scored = evaluation.response_quality(evaluation.answered(picked, tables.conversation_responses(spark, sf_dir)))
    return with_settled(scored.select("ord", "question_start", "response", "quality_score"), 6, "quality_score")


# ---- sources and sinks -----------------------------------------------------------------


@query
def csv_load(spark, sf_dir):
    """The events as CSV, loaded once into a Parquet table, then scanned for three of its columns."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    raw, loaded = folder_for(spark, sf_dir, "events_csv"), folder_for(spark, sf_dir, "events")
    stored.write_csv(events, raw)
    stored.load_once(spark, raw, loaded, events.schema)
    return stored.scan(spark, loaded, ["event_id", "event_type", "value"])


@query
def json_documents(spark, sf_dir):
    """Area profiles stored as JSON, read back as a corpus of files, and assembled to documents."""
    folder = folder_for(spark, sf_dir, "areas_json")
    tables.area_profiles(spark, sf_dir).drop("doc_id", "source").write.mode("overwrite").json(folder)
    made = retrieval.assemble(corpus.read_areas(spark, folder, lines=True))
    return made.select(
        "area", "page_content", F.endswith(F.col("metadata")["Source"], F.lit(".json")).alias("has_source")
    )


@query
def json_array_documents(spark, sf_dir):
    """Area profiles stored as files of one JSON array each, read back by splits of the files, and assembled to documents."""
    folder = folder_for(spark, sf_dir, "areas_arrays")
    corpus.write_arrays(tables.area_profiles(spark, sf_dir).drop("doc_id", "source"), folder)
    made = retrieval.assemble(corpus.read_areas(spark, folder, pattern="*.txt"))
    return made.select("area", "page_content", F.col("metadata")["Source"].isNotNull().alias("has_source"))


@query
def sales_refresh(spark, sf_dir):
    """Sales as CSV loaded into a table by month, then loaded again with other rows in every June, a month that was lacking, and one
    that is gone: rows, prices, and the refresh that wrote each month."""
    columns = ["month", "town", "flat_type", "resale_price"]
    now = sales(spark, sf_dir, *columns).where("month IS NOT NULL")
    lacking, folder = "1996-02-01", folder_for(spark, sf_dir, f"sales_refresh/{uuid4().hex}")
    june = F.when(F.month("month") == 6, F.col("resale_price") + 1.0).otherwise(F.col("resale_price"))
    gone = now.where(F.col("month") == lacking).withColumn("month", F.lit("2099-01-01").cast("date"))
    before = now.where(F.col("month") != lacking).withColumn("resale_price", june).union(gone)
    for number, rows in enumerate((before, now)):
        stored.write_csv(rows, f"{folder}/csv{number}")
        given = stored.read_csv(spark, f"{folder}/csv{number}", now.schema)
        listed = stored.refresh_months(spark, given, f"{folder}/table")
    held = stored.by_month(spark, f"{folder}/table", columns).groupBy("month").agg(
        F.count(F.lit(1)).alias("items"), settled(F.sum("resale_price"), 2).alias("total")
    )
    refresh = listed.select(F.col("month_of").cast("date").alias("month"), F.col("refresh").cast("bigint").alias("refresh"))
    return held.join(refresh, "month", "full")


def _exported(spark, sf_dir, rows, prefix, *suffix):
    """The rows as CSV folders per segment, each with its download name, read back."""
    named = forecast.export_names(rows, prefix, *suffix)
    folder = folder_for(spark, sf_dir, f"{prefix}_csv")
    stored.write_csv(named, folder, partition_by=SEGMENT)
    return stored.read_csv(spark, folder, named.schema)


@query
def csv_export(spark, sf_dir):
    ahead = forecast.accepted(_forecast(spark, sf_dir)).select(*SEGMENT, "month", *BAND)
    return with_settled(_exported(spark, sf_dir, ahead, "forecast", "12m"), 2, *BAND)


@query
def csv_export_history(spark, sf_dir):
    recent = _recent_history(spark, sf_dir)
    return with_settled(_exported(spark, sf_dir, recent, "history", "24m"), 6, "historical_price")


@query
def csv_export_comparables(spark, sf_dir):
    found = _comparables(spark, sf_dir).select(*SEGMENT, *segment.COMPARABLE_COLUMNS)
    return with_settled(_exported(spark, sf_dir, found, "comparables"), 6, "resale_price", *DISTANCES)


@query
def results_cases(spark, sf_dir):
    """The table of all cases stored with the time of evaluation, read back."""
    folder = folder_for(spark, sf_dir, "cases")
    stored.write_results(eval_table(spark, sf_dir), folder)
    return spark.read.parquet(folder).withColumn("dated", F.col("evaluated_at").isNotNull()).drop("evaluated_at")


@query
def results_sink(spark, sf_dir):
    """The overall scores stored with the time of evaluation, read back."""
    folder = folder_for(spark, sf_dir, "scores")
    stored.write_results(_overall(spark, sf_dir), folder)
    kept = spark.read.parquet(folder)
    return with_settled(kept.select("metric", "score", F.col("evaluated_at").isNotNull().alias("dated")), 6, "score")
