"""Monthly forecasts with a 95 % band for every segment, from its own history.

Per segment the monthly rate is a straight line in time plus a mean deviation per
calendar month; the band comes from the spread of what is left. Everything works on
one row per segment and month, so windows by segment see a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.functions import dates, features, numbers, text
from hearthline.operators.segment import (
    SEGMENT,
    USUAL_SIZE,
    last_months,
    price_per_area,
    request_keys,
    segmented,
    usual_district,
)

# Fixed value: the normal quantile of a 95 % band.
Z95 = 1.959963984540054
# Months of history a segment needs for a forecast, unless the caller says otherwise.
USUAL_LEAST_POINTS = 24


def segment_models(rates: DataFrame) -> DataFrame:
    """One row per segment: points, line, last month and rate, calendar deviations, spread of the rest."""
    segment = W.partitionBy(*SEGMENT)
    calendar = W.partitionBy(*SEGMENT, "calendar")
    y, t = F.col("price_per_sqm"), F.col("t")
    month = dates.month_number(F.col("month"))
    timed = rates.withColumns(
        {"t": (month - F.min(month).over(segment)).cast("double"), "calendar": F.month("month")}
    )
    lined = timed.withColumns({"slope": F.regr_slope(y, t).over(segment), "base": F.regr_intercept(y, t).over(segment)})
    off_line = lined.withColumn("off", y - F.col("base") - F.col("slope") * t)
    seasonal = off_line.withColumn("season", F.avg("off").over(calendar))
    return seasonal.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("points"),
        F.first("base").alias("base"),
        F.first("slope").alias("slope"),
        F.max("t").alias("last_t"),
        F.max("month").alias("last_month"),
        F.max_by("price_per_sqm", "month").alias("last_rate"),
        F.map_from_entries(F.collect_set(F.struct("calendar", F.coalesce("season", F.lit(0.0))))).alias("seasons"),
        F.coalesce(F.stddev_samp(F.col("off") - F.col("season")), F.lit(0.0)).alias("spread"),
    )


def _expected(step: Column) -> Column:
    calendar = F.pmod(F.month("last_month") - 1 + step, F.lit(12)) + 1
    season = F.coalesce(F.try_element_at("seasons", calendar.cast("int")), F.lit(0.0))
    return F.col("base") + F.col("slope") * (F.col("last_t") + step) + season


def calibration(last_rate: Column, next_rate: Column) -> Column:
    """Factor that starts the forecast at the last seen level; 1 where that is not a positive number."""
    factor = F.when(next_rate > 0, last_rate / F.nullif(next_rate, F.lit(0.0))).otherwise(F.lit(1.0))
    return F.when((factor > 0) & (factor < F.lit(float("inf"))), factor).otherwise(F.lit(1.0))


def segment_forecast(rates: DataFrame, requests: DataFrame, least_points: int = USUAL_LEAST_POINTS) -> DataFrame:
    """Per request and future month: predicted price of the requested size with its band.

    A segment with fewer than `least_points` months of history stays in the result as one row that says so.
    """
    return _forecast(rates, requests, least_points).drop("last_price")


def _forecast(rates: DataFrame, requests: DataFrame, least_points: int) -> DataFrame:
    """The same with the last observed price of the requested size."""
    keys = request_keys(requests)
    asked = requests.select(
        *keys,
        F.coalesce("floor_area_sqm", F.lit(USUAL_SIZE)).alias("_area"),
        F.col("horizon").cast("int").alias("_horizon"),
    )
    known = asked.join(segment_models(rates), SEGMENT, "left").withColumn(
        "status",
        F.when(F.coalesce("points", F.lit(0)) < least_points, F.lit("too little history")).otherwise(F.lit("ok")),
    )
    steps = F.when(F.col("status") == "ok", dates.steps_ahead(F.col("_horizon")))
    ahead = known.withColumn("step", F.explode_outer(steps))
    level = calibration(F.col("last_rate"), _expected(F.lit(1))) * F.col("_area")
    mean, band = _expected(F.col("step")), F.lit(Z95) * F.col("spread")
    return ahead.select(
        *keys,
        "status",
        F.coalesce("points", F.lit(0)).cast("bigint").alias("points"),
        F.col("step").cast("bigint").alias("step"),
        F.add_months(dates.month_start(F.col("last_month")), F.col("step")).alias("month"),
        numbers.at_least(mean * level, 0.0).alias("predicted_mean"),
        numbers.at_least((mean - band) * level, 0.0).alias("mean_ci_lower"),
        numbers.at_least((mean + band) * level, 0.0).alias("mean_ci_upper"),
        (F.col("last_rate") * F.col("_area")).alias("last_price"),
    )


def accepted(forecast: DataFrame) -> DataFrame:
    return forecast.where(F.col("status") == "ok")


def forecast_inputs(df: DataFrame, requests: DataFrame, model_columns: Sequence[str]) -> DataFrame:
    """The model's input columns for every future month of every request.

    All are 0 but the segment's usual district and its flat type column. A request whose
    flat type has no column keeps one row with status "no matching flat type".
    """
    last = price_per_area(df).groupBy(*SEGMENT).agg(F.max("month").alias("_last"))
    districts = usual_district(segmented(df), SEGMENT).withColumnRenamed("district_number", "_district")
    keys = request_keys(requests)
    rows = (
        requests.select(*keys, F.col("horizon").cast("int").alias("_horizon"))
        .join(last, SEGMENT)
        .join(districts, SEGMENT, "left")
        .withColumn("matched_column", features.matching_feature(F.col("flat_type"), model_columns))
    )
    steps = F.when(F.col("matched_column").isNotNull(), dates.steps_ahead(F.col("_horizon")))
    filled = {
        name: F.coalesce("_district", F.lit(0.0))
        if name == "district_number"
        else F.when(F.col("matched_column") == name, F.lit(1.0)).otherwise(F.lit(0.0))
        for name in model_columns
    }
    return rows.withColumn("step", F.explode_outer(steps)).select(
        *keys,
        F.when(F.col("step").isNull(), F.lit("no matching flat type")).otherwise(F.lit("ok")).alias("status"),
        "matched_column",
        F.col("step").cast("bigint").alias("step"),
        F.add_months(dates.month_start(F.col("_last")), F.col("step")).alias("month"),
        *[c.alias(n) for n, c in filled.items()],
    )


def chart_series(history: DataFrame, forecast: DataFrame, months: int = 24) -> DataFrame:
    """Recent history, an empty point after it, and the forecast as one series per request, with its y-range.

    Only requests with a forecast have a chart.
    """
    keys = request_keys(forecast)
    ahead = accepted(forecast).select(
        *keys,
        "month",
        F.col("predicted_mean").alias("price"),
        F.lit("Forecast").alias("type"),
        F.col("mean_ci_lower").alias("ci_lower"),
        F.col("mean_ci_upper").alias("ci_upper"),
    )
    charted = ahead.select(*keys).distinct()
    recent = last_months(history, months).join(charted, keys, "left_semi")
    past = recent.select(*keys, "month", "price", F.lit("Historical").alias("type"))
    gap = recent.groupBy(*keys).agg(F.date_add(F.max("month"), 1).alias("month"))
    gap = gap.withColumns({"price": F.lit(None).cast("double"), "type": F.lit("Gap")})
    series = past.unionByName(gap).unionByName(ahead, allowMissingColumns=True)
    chart = W.partitionBy(*keys)
    low, high = F.min("price").over(chart), F.max("price").over(chart)
    return series.withColumns(
        {
            "y_low": F.greatest(F.lit(0.0), low - numbers.axis_pad(low, high)),
            "y_high": high + numbers.axis_pad(low, high),
        }
    )


def headline(rates: DataFrame, requests: DataFrame, least_points: int = USUAL_LEAST_POINTS) -> DataFrame:
    """Last forecast against last observed price per request, as numbers and as text."""
    keys = request_keys(requests)
    ahead = accepted(_forecast(rates, requests, least_points)).groupBy(*keys).agg(
        F.max("last_price").alias("last_price"),
        F.max_by("predicted_mean", "month").alias("forecast_price"),
        F.max("step").alias("months"),
    )
    change = numbers.change_or_null(F.col("forecast_price"), F.col("last_price"))
    return ahead.select(
        *keys,
        "months",
        "last_price",
        "forecast_price",
        change.alias("change_pct"),
        numbers.money(F.col("forecast_price")).alias("forecast_text"),
        numbers.signed_percent(change).alias("change_text"),
    )


def export_names(df: DataFrame, prefix: str, *suffix: str) -> DataFrame:
    """Adds the download name of each row's segment: forecast_BEDOK_4_room_12m."""
    parts = [F.lit(prefix), F.col("town"), text.file_key(F.col("flat_type")), *[F.lit(s) for s in suffix]]
    return df.withColumn("export_name", F.concat_ws("_", *parts))
