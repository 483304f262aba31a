"""Market overview: snapshot, trends, shares, rankings, regression lines and map extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.functions import dates, numbers
from hearthline.operators.distribution import distribution
from hearthline.operators.ordering import first_per_group, newest_rows
from hearthline.runtime import side_by_side
from hearthline.schema import DISTANCES, require

# The variables a price can be set against.
EXPLANATORY = [
    "floor_area_sqm",
    "remaining_lease",
    "storey_mid",
    "nearest_mrt_distance_km",
    "nearest_hawker_distance_km",
    "nearest_supermarkets_distance_km",
]

MEDIAN = {"median": 0.5}


def per_dimension(df: DataFrame, dimensions: Sequence[str], keep: Sequence[str], whole: bool = False) -> DataFrame:
    """One row per sale and dimension: (dimension, category, kept columns).

    `whole` adds the dimension "all", whose category is null. A null category of a real
    dimension therefore stays apart from the whole.
    """
    entries = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category")) for d in dimensions]
    if whole:
        entries.append(F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("category")))
    return df.select(*keep, F.explode(F.array(*entries)).alias("_d")).select(
        "_d.dimension", "_d.category", *keep
    )


def kpi_snapshot(df: DataFrame, base_year: int = 2017) -> DataFrame:
    """One row: latest month against the month before, index against a base year, top region and flat type."""
    require(df, ["month", "resale_price", "region", "flat_type"])
    latest = df.agg(F.max("month")).scalar()
    previous = F.add_months(latest, -1)
    month = F.col("month")
    # As a range of days, which the Parquet reader can use to skip row groups; year() it cannot.
    in_base = month.between(F.to_date(F.lit(f"{base_year}-01-01")), F.to_date(F.lit(f"{base_year}-12-31")))

    periods = F.array(
        F.when(month == latest, F.lit("latest")),
        F.when(month == previous, F.lit("previous")),
        F.when(in_base, F.lit("base")),
    )
    in_period = (
        df.where((month == latest) | (month == previous) | in_base)
        .select("resale_price", F.explode(periods).alias("period"))
        .where(F.col("period").isNotNull())
    )
    now = df.where(month == latest)
    medians, regions = side_by_side(
        df.sparkSession,
        lambda: distribution(in_period, ["period"], "resale_price", MEDIAN),
        lambda: distribution(now, ["region"], "resale_price", MEDIAN).where(F.col("median").isNotNull()),
    )
    sales = in_period.groupBy("period").agg(F.count(F.lit(1)).alias("sales"))

    def of(period: str, column: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(column)))

    price_row = medians.agg(
        of("latest", "median").alias("median_price"),
        of("previous", "median").alias("prev_median_price"),
        of("base", "median").alias("base_median_price"),
    )
    count_row = sales.agg(of("latest", "sales").alias("transactions"), of("previous", "sales").alias("prev_transactions"))

    region_row = regions.agg(
        F.min(F.struct((-F.col("median")).alias("v"), F.col("region").alias("name"))).alias("top")
    ).select(F.col("top.name").alias("top_region"), (-F.col("top.v")).alias("top_region_median"))
    types = now.where(F.col("flat_type").isNotNull()).groupBy("flat_type").agg(F.count(F.lit(1)).alias("n"))
    type_row = types.agg(
        F.min(F.struct((-F.col("n")).alias("v"), F.col("flat_type").alias("name"))).alias("top"),
        F.sum("n").alias("n"),
    ).select(
        F.col("top.name").alias("top_flat_type"),
        numbers.half_even(F.lit(100.0) * -F.col("top.v") / F.col("n"), 1).alias("top_flat_type_share_pct"),
    )

    # Four one-row results side by side: each column has a value in exactly one of them.
    month_row = df.agg(F.max("month").alias("month"))
    rows = [price_row, count_row, region_row, type_row]
    stacked = month_row
    for row in rows:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    snapshot = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    index = numbers.index_of(F.col("median_price"), F.col("base_median_price"))
    return snapshot.select(
        "month",
        dates.long_month_name(F.col("month")).alias("month_name"),
        "median_price",
        "prev_median_price",
        numbers.change_or_zero(F.col("median_price"), F.col("prev_median_price")).alias("median_price_change_pct"),
        "transactions",
        "prev_transactions",
        numbers.change_or_zero(
            F.col("transactions").cast("double"), F.col("prev_transactions").cast("double")
        ).alias("transactions_change_pct"),
        index.alias("price_index"),
        (index - 100.0).alias("index_vs_base_pct"),
        "top_region",
        "top_region_median",
        "top_flat_type",
        "top_flat_type_share_pct",
    )


def _measured(df: DataFrame, measure: str) -> DataFrame:
    value = numbers.thousands(F.col(measure)) if measure == "resale_price" else F.col(measure)
    return df.withColumn("value", value)


def _between_months(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    df = df.where(F.col("month").isNotNull())
    if start:
        df = df.where(F.col("month") >= F.to_date(F.lit(start)))
    return df.where(F.col("month") <= F.to_date(F.lit(end))) if end else df


# The aggregate names a report may ask for.
PLAIN_AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max}


def trend(
    df: DataFrame,
    measure: str = "resale_price",
    group_by: str | None = None,
    aggregate: str = "mean",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """month [, group], value by month order; prices in thousands; a null group is a group."""
    keys = ["month"] + ([group_by] if group_by else [])
    rows = _measured(_between_months(require(df, [*keys, measure]), start, end), measure)
    if aggregate == "median":
        found = distribution(rows, keys, "value", MEDIAN, null_keys=True).select(*keys, F.col("median").alias("value"))
    else:
        found = rows.groupBy(*keys).agg(PLAIN_AGGREGATES[aggregate]("value").alias("value"))
    return found.orderBy(*keys)


def trend_sets(
    df: DataFrame,
    measure: str = "resale_price",
    dimensions: Sequence[str] = ("region", "flat_type", "flat_model"),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Every grouping and aggregate of `trend` in one job: (month, dimension, category, n, mean, median, min, max)."""
    rows = _measured(_between_months(df, start, end), measure)
    spread = per_dimension(rows, dimensions, ["month", "value"], whole=True)
    keys = ["month", "dimension", "category"]
    return distribution(spread, keys, "value", MEDIAN, null_keys=True)


def composition(df: DataFrame, column: str = "flat_type") -> DataFrame:
    """Sales per category with its share of all categorised sales, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("transactions"))
    share = F.lit(100.0) * F.col("transactions") / F.sum("transactions").over(W.partitionBy())
    return counts.withColumn("share_pct", numbers.half_even(share, 1)).orderBy(F.desc("transactions"), column)


def ranking(
    df: DataFrame,
    measure: str = "resale_price",
    dimensions: Sequence[str] = ("flat_type", "region", "town", "flat_model", "district_number"),
) -> DataFrame:
    """Mean and median of every category of every dimension, each with its place from the highest."""
    spread = per_dimension(df, dimensions, [measure]).where(F.col("category").isNotNull())
    found = distribution(spread, ["dimension", "category"], measure, MEDIAN)

    def place(v: str) -> Column:
        return F.row_number().over(W.partitionBy("dimension").orderBy(F.desc(v), "category")).cast("bigint")

    return found.select(
        "dimension",
        "category",
        "n",
        "mean",
        "median",
        place("mean").alias("mean_rank"),
        place("median").alias("median_rank"),
        F.count(F.lit(1)).over(W.partitionBy("dimension")).alias("categories"),
    )


def _line(x: str, y: str) -> list[Column]:
    a, b = F.col(y), F.col(x)
    slope, intercept = F.regr_slope(a, b), F.regr_intercept(a, b)
    return [
        F.regr_count(a, b).alias("n"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        F.min(b).alias("x_min"),
        F.max(b).alias("x_max"),
        (intercept + slope * F.min(b)).alias("y_at_min"),
        (intercept + slope * F.max(b)).alias("y_at_max"),
    ]


def regression(
    df: DataFrame, x: str, y: str = "resale_price", dimensions: Sequence[str] = ("region", "flat_type", "town")
) -> DataFrame:
    """Least-squares line of y on x for the whole market and for every category of each dimension."""
    complete = df.select(*dimensions, x, y).na.drop(subset=[x, y])
    spread = per_dimension(complete, dimensions, [x, y], whole=True)
    spread = spread.where((F.col("dimension") == "all") | F.col("category").isNotNull())
    return spread.groupBy("dimension", "category").agg(*_line(x, y))


def regression_all(df: DataFrame, y: str = "resale_price", variables: Sequence[str] = tuple(EXPLANATORY)) -> DataFrame:
    """The market-wide line of y on each explanatory variable."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("x")) for v in variables])
    spread = df.select(F.col(y).alias("y"), F.explode(pairs).alias("p")).select("p.variable", "p.x", "y")
    return spread.na.drop().groupBy("variable").agg(*_line("x", "y"))


def regression_grid(
    df: DataFrame,
    dimensions: Sequence[str] = ("region", "flat_type", "town"),
    measures: Sequence[str] = ("resale_price", "price_per_sqm"),
    variables: Sequence[str] = tuple(EXPLANATORY),
) -> DataFrame:
    """The line of every measure on every variable, for the whole market and every category of each dimension."""
    pairs = [
        F.struct(F.lit(v).alias("variable"), F.lit(m).alias("measure"), F.col(v).alias("x"), F.col(m).alias("y"))
        for v in variables
        for m in measures
    ]
    spread = per_dimension(df, dimensions, [*variables, *measures], whole=True)
    spread = spread.where((F.col("dimension") == "all") | F.col("category").isNotNull())
    rows = spread.select("dimension", "category", F.explode(F.array(*pairs)).alias("p")).select("dimension", "category", "p.*")
    keys = ["variable", "measure", "dimension", "category"]
    return rows.na.drop(subset=["x", "y"]).groupBy(*keys).agg(*_line("x", "y"))


# The columns of the market map.
MAP_COLUMNS = [
    "latitude",
    "longitude",
    "resale_price",
    "price_per_sqm",
    "flat_type",
    "flat_model",
    "floor_area_sqm",
    "storey_range",
    "region",
    "month",
    "district_number",
    "nearest_mrt_name",
    "nearest_mrt_distance_km",
    "nearest_schools_name",
    "nearest_schools_distance_km",
]

MAP_SCATTER = ["flat_type", "flat_model", "region", "district_number", "nearest_mrt_name", "nearest_schools_name"]


def map_extract(df: DataFrame, limit: int = 20_000) -> DataFrame:
    """The newest geocoded sales for the map, prices in thousands and also scaled to 0..1 over the extract."""
    located = require(df, MAP_COLUMNS).select(*MAP_COLUMNS).na.drop(subset=["latitude", "longitude"])
    shown = located.withColumns(
        {
            "resale_price": numbers.thousands(F.col("resale_price")),
            "price_per_sqm": numbers.half_away(F.col("price_per_sqm"), 2),
            "nearest_mrt_distance_km": numbers.half_away(F.col("nearest_mrt_distance_km"), 2),
            "nearest_schools_distance_km": numbers.half_away(F.col("nearest_schools_distance_km"), 2),
        }
    )
    # Numbers as whole multiples of a small unit: text that any engine writes alike.
    units = {"resale_price": 1e5, "latitude": 1e6, "longitude": 1e6, "floor_area_sqm": 100.0}
    scatter = [F.round(F.col(c) * per).cast("bigint").cast("string") for c, per in units.items()]
    scatter += [F.col(c).cast("string") for c in MAP_SCATTER]
    extract = newest_rows(shown, limit, "month", scatter)
    # At most `limit` rows: one window over them is one small task.
    every = W.partitionBy()
    price = F.col("resale_price")
    norm = numbers.scaled(price, F.min(price).over(every), F.max(price).over(every))
    return extract.withColumns({"price_norm": norm, "month": dates.month_name(F.col("month"))})


def heat_grid(df: DataFrame, cell: float = 0.01, weight: str = "resale_price") -> DataFrame:
    """Summed weight and sales per map cell of `cell` degrees."""
    located = df.na.drop(subset=["latitude", "longitude", weight])
    return located.groupBy(
        F.floor(F.col("latitude") / cell).alias("lat_cell"), F.floor(F.col("longitude") / cell).alias("lon_cell")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))


def town_map(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Up to `limit` newest geocoded sales per town as shown on its map, with the map's centre."""
    columns = [
        "town",
        "month",
        "resale_price",
        "price_per_sqm",
        "flat_type",
        "floor_area_sqm",
        "remaining_lease",
        "latitude",
        "longitude",
        *DISTANCES,
    ]
    located = require(df, columns).select(*columns).na.drop(subset=["town", "latitude", "longitude"])
    order = [F.desc("month"), *[F.col(c).asc_nulls_last() for c in columns[2:]]]
    # At most `limit` rows per town, so a window by town stays small.
    town = W.partitionBy("town")
    return first_per_group(located, ["town"], order, limit, "place").select(
        "town",
        "place",
        *map_point(),
        F.avg("latitude").over(town).alias("centre_latitude"),
        F.avg("longitude").over(town).alias("centre_longitude"),
    )


def map_point() -> list[Column]:
    """What a sale on the map shows."""
    return [
        dates.month_name(F.col("month")).alias("month_text"),
        numbers.half_even(numbers.thousands(F.col("resale_price")), 0).alias("resale_price_k"),
        numbers.half_even(F.col("price_per_sqm"), 0).alias("price_per_sqm"),
        F.col("flat_type"),
        numbers.half_even(F.col("floor_area_sqm"), 0).alias("floor_area_sqm"),
        F.concat(numbers.half_even(F.col("remaining_lease"), 0).cast("string"), F.lit(" yrs")).alias("lease_text"),
        F.col("latitude"),
        F.col("longitude"),
        *[numbers.half_even(F.col(c), 2).alias(c) for c in DISTANCES],
    ]
