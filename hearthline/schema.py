"""Table shapes, and checks that run on the driver before any job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The distance columns of a sale, in the order reports show them.
DISTANCES = [
    "nearest_mrt_distance_km",
    "nearest_schools_distance_km",
    "nearest_childcare_distance_km",
    "nearest_supermarkets_distance_km",
    "nearest_hawker_distance_km",
]

SALES = T.StructType(
    [
        T.StructField("month", T.DateType()),
        T.StructField("town", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("flat_type", T.StringType()),
        T.StructField("flat_model", T.StringType()),
        T.StructField("resale_price", T.DoubleType()),
        T.StructField("price_per_sqm", T.DoubleType()),
        T.StructField("floor_area_sqm", T.DoubleType()),
        T.StructField("remaining_lease", T.DoubleType()),
        T.StructField("storey_mid", T.DoubleType()),
        T.StructField("storey_range", T.StringType()),
        T.StructField("district_number", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("nearest_mrt_name", T.StringType()),
        T.StructField("nearest_schools_name", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in DISTANCES],
    ]
)

AREAS = T.StructType(
    [
        T.StructField("area", T.StringType()),
        T.StructField("hdb_price_range", T.StringType()),
        T.StructField("pros", T.ArrayType(T.StringType())),
        T.StructField("cons", T.ArrayType(T.StringType())),
        T.StructField("nearby_amenities", T.ArrayType(T.StringType())),
        T.StructField("has_hdb", T.BooleanType()),
    ]
)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame itself, or an error naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def with_missing_columns(df: DataFrame, columns: Iterable[str], kind: str = "double") -> DataFrame:
    """Adds each absent column as null."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def named_as(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Renames the caller's columns to the names used here: {"month": "sale_month", ...}."""
    require(df, roles.values())
    return df.withColumnsRenamed({theirs: ours for ours, theirs in roles.items()})


def forecast_shape(df: DataFrame) -> DataFrame:
    """Brings a forecast to (mean, mean_ci_lower, mean_ci_upper), taking the usual other names."""
    # Accepted spellings of each forecast column, most preferred first.
    spellings = {
        "mean": ["mean", "predicted_mean", "forecast", "yhat"],
        "mean_ci_lower": ["mean_ci_lower", "lower"],
        "mean_ci_upper": ["mean_ci_upper", "upper"],
    }
    found = {}
    for wanted, names in spellings.items():
        present = [n for n in names if n in df.columns]
        if not present:
            raise ValueError(f"forecast has no '{wanted}' column: {df.columns}")
        found[present[0]] = wanted
    return df.withColumnsRenamed(found)


def checked(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and a table of how often each rule is broken: reason, rows.

    `rules` maps what is wrong with a row to the condition that it must meet; a condition that is null isn't met. A row that breaks
    several rules is counted under the first one, so accepted rows and counts add up to all rows; a rule that no row
    breaks has no count. Nothing is gathered: the counts are combined before their shuffle.
    """
    reason = F.coalesce(*[F.when(~F.coalesce(kept, F.lit(False)), what) for what, kept in rules.items()], F.lit(None).cast("string"))
    judged = df.withColumn("_reason", reason)
    accepted = judged.where("_reason IS NULL").drop("_reason")
    rejected = judged.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    return accepted, rejected


# What a forecast's row must meet.
FORECAST_RULES = {
    "no mean": "mean IS NOT NULL AND NOT isnan(mean)",
    "no band": "mean_ci_lower IS NOT NULL AND mean_ci_upper IS NOT NULL",
    "negative": "mean_ci_lower >= 0",
    "mean outside its band": "mean BETWEEN mean_ci_lower AND mean_ci_upper",
}


def checked_forecast(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A forecast in any of the accepted spellings: its sound rows in the usual one, and the counted reasons of the others.

    Values that are no numbers count as missing.
    """
    shaped = forecast_shape(df)
    numbers = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in ("mean", "mean_ci_lower", "mean_ci_upper")}
    return checked(shaped.withColumns(numbers), {what: F.expr(rule) for what, rule in FORECAST_RULES.items()})
