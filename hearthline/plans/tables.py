"""The given tables in the shapes the operators take."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.schema import SALES
from hearthline.runtime import shared_folder, workspace
from hearthline.sources import files
from hearthline.sources.tables import nan_as_null

# Names a Parquet table with the columns of schema.SALES, to be used instead of the given tables.
SALES_TABLE = "spark.hearthline.sales"

_frames: dict[tuple[str, str], tuple[str, DataFrame]] = {}
_one_load = threading.Lock()


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Schema and file list are read again only when its files have changed, not by every query."""
    key, state = (spark.sparkContext.applicationId, path), files.mark(spark, path)
    if key not in _frames or _frames[key][0] != state:
        _frames[key] = (state, spark.read.parquet(path))
    return _frames[key][1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _parquet(spark, f"{sf_dir}/{name}.parquet")


def folder_for(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of this application for something made from the tables of sf_dir."""
    return f"{workspace(spark)}/{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}/{name}"


def _km(key: str, modulus: int, missing_every: int | None = None) -> str:
    km = f"CAST({key} % {modulus} AS DOUBLE) / 10"
    return f"CASE WHEN {key} % {missing_every} = 0 THEN NULL ELSE {km} END" if missing_every else km


def _degrees(base: str, key: str, step: str) -> str:
    there = f"CAST({base} AS DOUBLE) + CAST({key} % 1000 AS DOUBLE) * CAST({step} AS DOUBLE)"
    return f"CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE {there} END"


# How each sales column is made from a line item and its order, home and part.
SALES_COLUMNS = {
    "month": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "town": "n_name",
    "region": "r_name",
    "flat_type": "o_orderpriority",
    "flat_model": "p_brand",
    "resale_price": "l_extendedprice",
    "price_per_sqm": "l_extendedprice / l_quantity",
    "floor_area_sqm": "CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity END",
    "remaining_lease": "CAST(p_size AS DOUBLE)",
    "storey_mid": "CAST(l_linenumber AS DOUBLE)",
    "storey_range": "concat('STOREY ', l_linenumber)",
    "district_number": "CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_suppkey % 28 + 1 END",
    "latitude": _degrees("1.22", "l_orderkey", "0.00025"),
    "longitude": _degrees("103.6", "l_partkey", "0.0004"),
    "nearest_mrt_name": "concat('MRT_', l_suppkey % 40)",
    "nearest_schools_name": "concat('SCHOOL_', l_partkey % 60)",
    "nearest_mrt_distance_km": _km("l_suppkey", 50, 13),
    "nearest_schools_distance_km": _km("l_partkey", 40, 11),
    "nearest_childcare_distance_km": _km("l_suppkey", 20),
    "nearest_supermarkets_distance_km": _km("l_orderkey", 25),
    "nearest_hawker_distance_km": _km("l_partkey", 30),
}


# What of each given table the sales columns are made from.
GIVEN_COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderpriority"],
    "customer": ["c_custkey", "c_nationkey"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "part": ["p_partkey", "p_brand", "p_size"],
}


def joined_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as property sales, those of a month together. Dimensions are joined left on their keys, so no sale is lost.

    Line items are by far the most rows, so they are shuffled as few narrow columns: orders find their customer before they are joined to
    line items, sales get together by month with the key of their nation and are sorted, and the many columns are made after that.
    """
    given = {n: table(spark, sf_dir, n).select(*columns) for n, columns in GIVEN_COLUMNS.items()}
    homes = given["orders"].join(given["customer"], F.expr("o_custkey = c_custkey"), "left").drop("o_custkey", "c_custkey")
    places = given["nation"].join(given["region"], F.expr("n_regionkey = r_regionkey"), "left")
    month = F.expr(SALES_COLUMNS["month"])
    rows = (
        given["lineitem"]
        .withColumn("l_shipdate", month)
        .join(given["part"], F.expr("l_partkey = p_partkey"), "left")
        .drop("p_partkey")
        .join(homes, F.expr("l_orderkey = o_orderkey"), "left")
        .drop("o_orderkey")
        .hint("rebalance", "l_shipdate")
    )
    named = rows.join(places, F.expr("c_nationkey = n_nationkey"), "left")
    return named.sortWithinPartitions("l_shipdate").select(
        *[F.expr(made).cast(SALES[c].dataType).alias(c) for c, made in SALES_COLUMNS.items()]
    )


def sales_table(spark: SparkSession, sf_dir: str) -> str:
    """Where the sales table lies; the first call for this content of the given tables joins and stores it.

    The table lies beside the applications' own folders, under a name made from the files it comes from, so that later
    applications find it. It is built in this application's folder and then renamed, so it is there whole or not at all.
    Files hold few months each, and AQE splits a month that is too large for one, so
    a query for some months skips the other files.
    """
    stored = spark.conf.get(SALES_TABLE, None)
    if stored:
        return stored
    state = hashlib.md5(files.mark(spark, sf_dir).encode()).hexdigest()[:8]
    path = f"{shared_folder(spark)}/hearthline/tables/sales-{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}-{state}"
    with _one_load:
        if not files.exists(spark, path + "/_SUCCESS"):
            built = folder_for(spark, sf_dir, f"sales-{state}")
            rows = nan_as_null(joined_sales(spark, sf_dir))
            rows.write.mode("overwrite").parquet(built)
            if not files.exists(spark, path):
                files.move(spark, built, path)
    return path


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Only the named columns of the sales table."""
    return _parquet(spark, sales_table(spark, sf_dir)).select(*columns)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in message types; in odd conversations the assistant's turns are tool results."""
    role, odd = F.col("role"), F.col("conv_id") % 2 == 1
    kind = (
        F.when(role == "user", "human").when((role == "assistant") & odd, "tool").when(role == "assistant", "ai").otherwise(role)
    )
    calls = (role == "assistant") & ~odd & (F.col("turn") % 4 == 1)
    none = F.array().cast("array<string>")
    tool_calls = F.when(calls, F.array(F.lit("retrieve"))).otherwise(none)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", kind.alias("role"), "text", tool_calls.alias("tool_calls")
    )


def _by_language(values: dict[str, list[str]]) -> Column:
    chosen = F.array().cast("array<string>")
    for language, words in values.items():
        listed = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        chosen = F.when(F.col("lang") == language, listed).otherwise(chosen)
    return chosen


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled case per document; the expected words depend on its language."""
    category = F.create_map(
        *[F.lit(x) for x in ("en", "price_prediction", "fr", "area_info", "de", "price_info", "es", "comparison")]
    )
    length = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"),
        F.try_element_at(category, F.col("lang")).alias("category"),
        F.when(length < 500, "easy").when(length < 2000, "medium").otherwise("hard").alias("difficulty"),
        _by_language(
            {"en": ["The", "dashboard", "tion", "is"], "fr": ["que", "EAU", "le"], "de": ["und", "ich"], "es": []}
        ).alias("expected_keywords"),
        _by_language({"en": ["on", "Marina"], "fr": [], "de": ["Ver"], "es": ["la", "los", "Que"]}).alias("expected_areas"),
        F.col("text").alias("response"),
    )


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("ord", "question", "response")


def conversation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message answers the question numbered like its conversation; later turns replace earlier ones."""
    question = F.concat(F.lit("q"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("ord"), question.alias("question"), F.col("text").alias("response")
    )


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("value").alias("seconds"), "event_type"
    )


def area_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as area profiles: the lines of the whole text are the pros; some have no amenities."""
    tags = F.array("lang", "source")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("Area "), F.col("doc_id").cast("string")).alias("area"),
        F.concat(F.lit("SGD "), F.col("n_chars").cast("string"), F.lit("K")).alias("hdb_price_range"),
        F.split("text", "\n", -1).alias("pros"),
        tags.alias("cons"),
        F.when(F.col("lang") != "es", F.array("source")).alias("nearby_amenities"),
        (F.col("lang") == "en").alias("has_hdb"),
        "source",
    )
