"""Category columns and model features as projections, never joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import numbers, text

# The region column of each town.
TOWN_REGION = {
    "ANG MO KIO": "region_Central",
    "BEDOK": "region_East",
    "BISHAN": "region_Central",
    "BUKIT BATOK": "region_West",
    "BUKIT MERAH": "region_Central",
    "BUKIT PANJANG": "region_West",
    "BUKIT TIMAH": "region_Central",
    "CENTRAL AREA": "region_Central",
    "CHOA CHU KANG": "region_West",
    "CLEMENTI": "region_West",
    "GEYLANG": "region_Central",
    "HOUGANG": "region_Northeast",
    "JURONG EAST": "region_West",
    "JURONG WEST": "region_West",
    "KALLANG/WHAMPOA": "region_Central",
    "MARINE PARADE": "region_East",
    "PASIR RIS": "region_East",
    "PUNGGOL": "region_Northeast",
    "QUEENSTOWN": "region_Central",
    "SEMBAWANG": "region_North",
    "SENGKANG": "region_Northeast",
    "SERANGOON": "region_Northeast",
    "TAMPINES": "region_East",
    "TOA PAYOH": "region_Central",
    "WOODLANDS": "region_North",
    "YISHUN": "region_North",
}

# The numeric features of a price request.
NUMERIC_FEATURES = [
    "floor_area_sqm",
    "remaining_lease",
    "nearest_schools_distance_km",
    "nearest_childcare_distance_km",
    "nearest_supermarkets_distance_km",
    "nearest_hawker_distance_km",
    "nearest_mrt_distance_km",
]

def town_region(town: Column) -> Column:
    """The region column of a town through the fixed lookup; null where unknown."""
    lookup = F.create_map(*[F.lit(x) for pair in TOWN_REGION.items() for x in pair])
    return F.try_element_at(lookup, town)


def region_feature(region: Column) -> Column:
    """A stored region name as a feature column name: `MIDDLE EAST` is `region_Middle_East`."""
    return F.concat(F.lit("region_"), F.replace(F.initcap(region), F.lit(" "), F.lit("_")))


def categories(df: DataFrame, c: Column, most: int = 1000) -> list[str]:
    """The sorted distinct values of a column.

    One-hot columns are named from the data, so this is the one place where values come
    to the driver. `most` bounds how many columns a caller is ready to have; a column with more values is an error.
    """
    found = df.select(c.alias("v")).distinct().na.drop().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories")
    return sorted(row["v"] for row in found)


def one_hot(value: Column, names: Sequence[str]) -> dict[str, Column]:
    """A 0/1 column per name; all 0 where the value is null or unknown."""
    return {n: F.coalesce(numbers.flag(value == F.lit(n)), F.lit(0.0)) for n in names}


def sale_features(
    df: DataFrame, flat_columns: Sequence[str], region_columns: Sequence[str], region: Column
) -> DataFrame:
    """Sales with year, flat type and region columns added."""
    flat = text.feature_name(text.label(F.col("flat_type")))
    return df.withColumns(
        {"year": F.year("month").cast("bigint")}
        | one_hot(flat, flat_columns)
        | one_hot(region, region_columns)
    )


def request_features(
    requests: DataFrame,
    flat_columns: Sequence[str],
    region_columns: Sequence[str],
    region: Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One feature row per request: seven numbers (absent or null is 0), flat type and region flags."""
    flat = text.feature_name(text.label(F.col("flat_type")))
    numbers = {
        n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in requests.columns else F.lit(0.0)
        for n in NUMERIC_FEATURES
    }
    made = numbers | one_hot(flat, flat_columns) | one_hot(region, region_columns)
    return requests.select(*keep, *[c.alias(n) for n, c in made.items()])


def aligned(rows: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in its order; spaces read as underscores, absent ones are 0."""
    columns = []
    for name in wanted:
        held = name.replace(" ", "_")
        value = F.coalesce(F.col(held).cast("double"), F.lit(0.0)) if held in rows.columns else F.lit(0.0)
        columns.append(value.alias(name))
    return rows.select(*keep, *columns)


def matching_feature(labelled: Column, model_columns: Sequence[str]) -> Column:
    """The model's column for a flat type: exact spellings first, then the separator-blind key."""
    flat = [c for c in model_columns if "flat_type" in c.lower()]
    spellings = [
        text.feature_name(labelled),
        F.concat(F.lit("flat_type_"), labelled),
        F.concat(F.lit("flat_type_"), F.replace(labelled, F.lit("_"), F.lit(" "))),
    ]
    exact = [F.when(s.isin(list(model_columns)), s) for s in spellings]
    loose = [
        F.when(
            text.loose_key(labelled) == text.loose_key(F.replace(F.lit(c), F.lit("flat_type_"), F.lit(""))),
            F.lit(c),
        )
        for c in flat
    ]
    return F.coalesce(*exact, *loose, F.lit(None).cast("string"))
