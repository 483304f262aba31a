"""Sales tables: CSV load once to Parquet, pruned scans, CSV and Parquet output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions import dates
from hearthline.runtime import durable
from hearthline.schema import SALES, require
from hearthline.sources import corpus, files


def nan_as_null(df: DataFrame) -> DataFrame:
    """Spark sorts NaN above every number; here it only ever means a missing value."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = SALES) -> DataFrame:
    """A CSV file with a header row. Pass schema=None to infer types, at the price of a second pass.

    A date may be a day or a month, `2020-01-31` or `2020-01`. Any other date, a number that is none, and a row
    with too few or too many values fail the job.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is None:
        return nan_as_null(reader.option("inferSchema", True).csv(path))
    days = [f.name for f in schema.fields if isinstance(f.dataType, T.DateType)]
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in days else f.dataType, f.nullable) for f in schema.fields]
    )
    rows = reader.schema(as_text).csv(path)
    return nan_as_null(rows.withColumns({d: dates.strict_date(F.col(d)) for d in days}))


def load_once(
    spark: SparkSession, csv_path: str | list[str], table_path: str, schema: T.StructType | None = SALES
) -> DataFrame:
    """Turns a CSV into a Parquet table unless the finished table is already there; returns the table."""
    if not files.exists(spark, table_path + "/_SUCCESS"):
        read_csv(spark, csv_path, schema).write.mode("overwrite").parquet(table_path)
    return spark.read.parquet(table_path)


def scan(spark: SparkSession, table_path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns of a Parquet table reach the reader."""
    return require(spark.read.parquet(table_path), columns).select(*columns)


def write_csv(df: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> None:
    """CSV with header, one folder per value of `partition_by`; AQE splits a value too large for one file."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(folder)


def write_results(metrics: DataFrame, folder: str) -> None:
    """Adds the time of evaluation and stores the rows as Parquet."""
    metrics.withColumn("evaluated_at", F.current_timestamp()).write.mode("overwrite").parquet(folder)


def refresh_months(spark: SparkSession, rows: DataFrame, folder: str, month: str = "month") -> DataFrame:
    """Brings a table stored by month up to date: only months whose rows differ from the stored ones are written.

    The folder holds the rows, one partition per month, and a list of the months with their number of rows, a fingerprint of all their
    values, and the refresh that last wrote them. The list is stored under a new number after the rows, so an interrupted refresh is
    done again by the next one. Returns that list: month, items, fingerprint, refresh. Rows without a month are a month of
    their own.
    """
    name = f"{month}_of"
    dated = rows.withColumn(name, F.coalesce(F.col(month).cast("string"), F.lit("none")))
    marks = durable(corpus.fingerprint(dated, rows.columns, [name]))
    last = corpus.last_version(spark, folder)
    old = spark.read.parquet(f"{folder}/manifest/version={last}") if last else marks.withColumn("refresh", F.lit(0)).limit(0)
    known = old.select(F.col(name), F.col("fingerprint").alias("_print"), "refresh")
    both = durable(marks.join(known, name, "full"))
    same = F.coalesce(F.col("fingerprint") == F.col("_print"), F.lit(False))
    if last and both.where(~same).isEmpty():
        return old
    changed = both.where(~same & F.col("fingerprint").isNotNull()).select(name)
    fresh = dated.join(changed, name, "left_semi").hint("rebalance", name)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(f"{folder}/rows")
    for gone in both.where(F.col("fingerprint").isNull()).select(name).toLocalIterator():
        files.remove(spark, f"{folder}/rows/{name}={gone[0]}")
    refresh = F.when(same, F.col("refresh")).otherwise(last + 1).alias("refresh")
    listed = both.where("fingerprint IS NOT NULL").select(name, "items", "fingerprint", refresh)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={last + 1}")
    return spark.read.parquet(f"{folder}/manifest/version={last + 1}")


def by_month(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a table that refresh_months keeps."""
    return spark.read.parquet(f"{folder}/rows").select(*columns)
