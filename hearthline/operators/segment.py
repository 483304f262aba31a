"""Figures per segment, a segment being a town and a flat type; all segments are computed at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.functions import dates, numbers, text
from hearthline.operators.distribution import distribution
from hearthline.operators.market import map_point
from hearthline.operators.ordering import first_per_group
from hearthline.schema import DISTANCES, require, with_missing_columns
from hearthline.runtime import durable

SEGMENT = ["town", "flat_type"]

# What a request gets when the data or the caller says nothing.
SMALLEST_SIZE = 20.0
LARGEST_SIZE = 200.0
USUAL_SIZE = 80.0
USUAL_LEASE = 60.0
USUAL_HORIZON = 12
USUAL_DISTANCES = {
    "nearest_mrt_distance_km": 1.0,
    "nearest_schools_distance_km": 1.5,
    "nearest_childcare_distance_km": 1.5,
    "nearest_supermarkets_distance_km": 1.0,
    "nearest_hawker_distance_km": 1.0,
}


def request_keys(df: DataFrame) -> list[str]:
    """What tells requests, and rows made for them, apart: the segment, and request_id if there is one."""
    return [c for c in ("request_id",) if c in df.columns] + SEGMENT


def segmented(df: DataFrame) -> DataFrame:
    """Sales that belong to a segment, flat types in their normalised spelling."""
    require(df, SEGMENT)
    return df.withColumn("flat_type", text.label(F.col("flat_type"))).na.drop(subset=SEGMENT)


def _profile(df: DataFrame) -> DataFrame:
    """Quantiles of size and, if there, of lease per segment, and of size over the market, in one job.

    Sizes and leases take few different values, so equal ones are counted before anything else.
    """
    require(df, [*SEGMENT, "floor_area_sqm"])
    measures = [c for c in ("floor_area_sqm", "remaining_lease") if c in df.columns]
    town, flat, nowhere = F.col("town"), F.col("flat_type"), F.lit(None).cast("string")
    here = town.isNotNull() & flat.isNotNull()

    def entry(part: str, t: Column, f: Column, v: str) -> Column:
        return F.struct(F.lit(part).alias("part"), t.alias("town"), f.alias("flat_type"), F.col(v).alias("v"))

    entries = [entry("market", nowhere, nowhere, "floor_area_sqm")]
    entries += [F.when(here, entry(m, town, flat, m)) for m in measures]
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
    kinds = durable(rows.groupBy("part", *SEGMENT, "v").agg(F.count(F.lit(1)).alias("times")))
    labelled = kinds.withColumn("flat_type", text.label(flat))
    edges = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    return durable(distribution(labelled, ["part", *SEGMENT], "v", edges, null_keys=True, weight="times"))


def _bounds(profile: DataFrame) -> DataFrame:
    own = profile.where(F.col("part") == "floor_area_sqm").select(*SEGMENT, "q05", "q95", "q50")
    market = profile.where(F.col("part") == "market").select(F.struct("q05", "q95")).scalar()
    # Flat types are a handful of categories: one small array, not a join of two tables.
    types = own.select("flat_type").distinct().agg(F.array_sort(F.collect_set("flat_type"))).scalar()
    towns = own.select("town").distinct()
    grid = towns.select("town", F.explode(types).alias("flat_type"))
    low = F.floor(F.coalesce("q05", market["q05"], F.lit(SMALLEST_SIZE))).cast("double")
    high = F.ceil(F.coalesce("q95", market["q95"], F.lit(LARGEST_SIZE))).cast("double")
    return (
        grid.join(own, SEGMENT, "left")
        .select(*SEGMENT, low.alias("low"), high.alias("high"), F.coalesce("q50", F.lit(USUAL_SIZE)).alias("size"))
        .withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1.0).otherwise(F.col("high")))
        .select(*SEGMENT, "low", "high", numbers.clamp(F.col("size"), F.col("low"), F.col("high")).alias("default_size"))
    )


def size_bounds(df: DataFrame) -> DataFrame:
    """town, flat_type, low, high, default_size for every town with every flat type.

    Bounds are the whole numbers around the 5 % and 95 % quantiles of a segment's sizes,
    those of the whole market where the segment has no sale.
    """
    return _bounds(_profile(df.select(*SEGMENT, "floor_area_sqm")))


def usual_requests(df: DataFrame, horizon: int = USUAL_HORIZON) -> DataFrame:
    """One request per segment: its default size, the whole years of its median lease, usual distances."""
    profile = _profile(require(df, ["remaining_lease"]))
    leases = profile.where(F.col("part") == "remaining_lease").select(*SEGMENT, F.col("q50").alias("lease"))
    lease = F.coalesce(F.floor("lease").cast("double"), F.lit(USUAL_LEASE))
    return (
        _bounds(profile)
        .join(leases, SEGMENT, "left")
        .select(
            *SEGMENT,
            F.col("default_size").alias("floor_area_sqm"),
            lease.alias("remaining_lease"),
            *[F.lit(km).alias(name) for name, km in USUAL_DISTANCES.items()],
            F.lit(horizon).alias("horizon"),
        )
    )


def price_per_area(df: DataFrame) -> DataFrame:
    """Segment sales with a month and a usable price per sqm, recomputed from price and size."""
    require(df, [*SEGMENT, "month", "resale_price", "floor_area_sqm"])
    rate = numbers.ratio(F.col("resale_price"), F.col("floor_area_sqm"))
    return segmented(df).select(*SEGMENT, "month", rate.alias("rate")).na.drop(subset=["month", "rate"])


def monthly_rates(df: DataFrame) -> DataFrame:
    """town, flat_type, month, price_per_sqm (the month's median), n."""
    found = distribution(price_per_area(df), [*SEGMENT, "month"], "rate", {"price_per_sqm": 0.5})
    return found.select(*SEGMENT, "month", "price_per_sqm", "n")


def recent_rates(df: DataFrame, months: int = 24) -> DataFrame:
    """The same, within `months` of each segment's last month only; other sales don't reach the medians."""
    rows = price_per_area(df)
    last = durable(rows.groupBy(*SEGMENT).agg(F.max("month").alias("_last")))
    recent = rows.join(last, SEGMENT).where(F.col("month") >= F.add_months("_last", -months)).drop("_last")
    found = distribution(recent, [*SEGMENT, "month"], "rate", {"price_per_sqm": 0.5})
    return found.select(*SEGMENT, "month", "price_per_sqm", "n")


def segment_history(rates: DataFrame, requests: DataFrame) -> DataFrame:
    """Monthly price of the requested size: the rate times the request's area."""
    keys = request_keys(requests)
    areas = requests.select(*keys, F.coalesce("floor_area_sqm", F.lit(USUAL_SIZE)).alias("_area"))
    return rates.join(areas, SEGMENT).select(
        *keys,
        "month",
        "price_per_sqm",
        (F.col("price_per_sqm") * F.col("_area")).alias("price"),
        F.lit("Historical (area-adjusted)").alias("type"),
    )


def last_months(history: DataFrame, months: int = 24) -> DataFrame:
    """The rows within `months` of each history's own last month."""
    last = F.max("month").over(W.partitionBy(*request_keys(history)))
    return history.withColumn("_last", last).where(F.col("month") >= F.add_months("_last", -months)).drop("_last")


def usual_district(df: DataFrame, keys: Sequence[str] = ("town",)) -> DataFrame:
    """The most frequent district per group, the smallest of equals, 0 where none is known."""
    keys = list(keys)
    counts = df.na.drop(subset=keys).groupBy(*keys, "district_number").agg(F.count("district_number").alias("n"))
    best = F.min(F.when(F.col("n") > 0, F.struct(-F.col("n"), F.col("district_number").alias("d"))))["d"]
    return counts.groupBy(*keys).agg(F.coalesce(best.cast("double"), F.lit(0.0)).alias("district_number"))


# The columns of the table of comparable sales.
COMPARABLE_COLUMNS = ["month", "floor_area_sqm", "remaining_lease", *DISTANCES, "resale_price"]

# Width of the size classes on a log scale: the span from 85 % to 115 % meets at most two.
SIZE_CLASS = 0.3023
LEASE_CLASS = 20.0


def comparables(
    df: DataFrame, requests: DataFrame, k: int = 25, columns: Sequence[str] = tuple(COMPARABLE_COLUMNS)
) -> DataFrame:
    """Per request the k newest sales of its segment within 15 % of its size and 10 years of its lease.

    Size and lease classes make the range conditions an equi-join, and only k rows per
    request and map task are shuffled. The sales are thinned out first: whether a sale is comparable depends only on segment, size and lease, so of
    sales equal in these only the k newest can ever be shown. That bounds the join by the
    number of different sizes and leases. The requests are stored when this is called.
    """
    sales = segmented(with_missing_columns(df, columns)).select(*SEGMENT, *columns)
    sales = sales.na.drop(subset=["floor_area_sqm", "remaining_lease"]).where(F.col("floor_area_sqm") >= 0)
    order = [F.col("month").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns if c != "month"]]

    def size_class(c):
        return F.coalesce(F.floor(F.ln(F.nullif(c, F.lit(0.0))) / SIZE_CLASS), F.lit(-1_000_000))

    def lease_class(c):
        return F.floor(c / LEASE_CLASS)

    area, lease = F.col("_area"), F.col("_lease")
    asked = requests.select(
        *SEGMENT, F.col("floor_area_sqm").alias("_area"), F.col("remaining_lease").alias("_lease")
    ).distinct()
    asked = durable(
        asked.withColumns(
            {
                "_area_from": area * 0.85,
                "_area_to": area * 1.15,
                "_lease_from": F.greatest(F.lit(0.0), lease - 10.0),
                "_lease_to": F.least(F.lit(99.0), lease + 10.0),
            }
        ).where((area >= 0) & (F.col("_lease_from") <= F.col("_lease_to")))
    )
    kind = [*SEGMENT, "floor_area_sqm", "remaining_lease"]
    sales = first_per_group(sales, kind, order, k, "_r").drop("_r")
    sizes = F.sequence(size_class(F.col("_area_from")), size_class(F.col("_area_to")))
    leases = F.sequence(lease_class(F.col("_lease_from")), lease_class(F.col("_lease_to")))
    classes = asked.withColumn("_size_class", F.explode(sizes)).withColumn("_lease_class", F.explode(leases))
    located = sales.withColumns(
        {"_size_class": size_class(F.col("floor_area_sqm")), "_lease_class": lease_class(F.col("remaining_lease"))}
    )
    near = located.join(classes, [*SEGMENT, "_size_class", "_lease_class"]).where(
        F.col("floor_area_sqm").between(F.col("_area_from"), F.col("_area_to"))
        & F.col("remaining_lease").between(F.col("_lease_from"), F.col("_lease_to"))
    )
    conditions = [*SEGMENT, "_area", "_lease"]
    found = first_per_group(near, conditions, order, k)
    keys = request_keys(requests)
    if keys != SEGMENT:
        # Requests that ask the same share one search.
        asking = requests.select(*keys, F.col("floor_area_sqm").alias("_area"), F.col("remaining_lease").alias("_lease"))
        found = found.join(asking, conditions)
    return found.select(
        *keys,
        area.alias("request_area"),
        lease.alias("request_lease"),
        "rank",
        *columns,
    )


def comparables_map(df: DataFrame, requests: DataFrame, limit: int = 1000) -> DataFrame:
    """Up to `limit` newest comparable sales with a place on the map, as the map shows them."""
    columns = [*COMPARABLE_COLUMNS, "price_per_sqm", "latitude", "longitude"]
    located = df.na.drop(subset=["latitude", "longitude"])
    found = comparables(located, requests, limit, columns)
    keys = [c for c in request_keys(found) if c != "flat_type"]
    return found.select(*keys, "request_area", "request_lease", "rank", *map_point())


def shown_comparables(found: DataFrame) -> DataFrame:
    """Comparables as the report prints them."""
    return found.select(
        *request_keys(found),
        "rank",
        dates.year_month(F.col("month")).alias("month"),
        numbers.fixed(F.col("floor_area_sqm"), 1).alias("floor_area_sqm"),
        numbers.fixed(F.col("remaining_lease"), 0).alias("remaining_lease"),
        *[numbers.kilometres(F.col(c)).alias(c) for c in DISTANCES],
        numbers.money(F.col("resale_price"), 2).alias("resale_price"),
    )
