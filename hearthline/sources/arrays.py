"""Large JSON arrays, cut into their entries by many tasks.

A file is read in splits, and a split in pieces that end at a closing brace, so neither needs line breaks. Whether a piece
begins inside a string, how deep it is nested, and how many entries ended before it depends on all that comes before. Each of these
is a running sum over the file's pieces, of quotes, of brackets outside strings, and of ends of entries. A running sum
is taken within each split, and the splits' totals, a few rows per file, say where each split begins. No task sees more than a
split or an entry. What each sum needs is stored in the shared folder before the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.runtime import durable

# A string literal, or what a piece holds of one: from a quote to the next that isn't escaped, or to the end.
STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)'
SPLIT = ["source", "block"]


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign)))


def _deeper(inside: bool) -> Column:
    """How many levels a piece leads down, with the brace behind it, if it begins inside a string, or outside."""
    outside = F.regexp_replace(F.concat(F.lit('"' if inside else ""), "value"), STRING, "")
    opened = _count(outside, "{") + _count(outside, "[") - _count(outside, "]")
    return opened - F.when((F.col("quotes") + int(inside)) % 2 == 0, 1).otherwise(0)


def _with_running(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier pieces of the file."""
    totals = pieces.groupBy(*SPLIT).agg(F.sum(value).alias("_total"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*SPLIT, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    earlier = W.partitionBy(*SPLIT).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return pieces.join(offsets, SPLIT).withColumn(name, F.col("_offset") + inside).drop("_offset")


def entries(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """source (path of the file), entry_no (from 0) and entry: the text of every object of each file's array.

    A file may also hold one object alone. Anything else at the top level, and brackets or quotes that don't close, fail the job.
    """
    read = spark.read.option("lineSep", "}").option("pathGlobFilter", pattern).text(path)
    # Escaped characters can't be quotes that open or close.
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = durable(
        read.select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            "value",
            _count(plain, '"').alias("quotes"),
        ).select("*", _deeper(False).alias("deeper_outside"), _deeper(True).alias("deeper_inside"))
    )
    first = F.substring(F.ltrim(F.col("value"), F.lit(" \t\r\n\ufeff")), 1, 1)
    kinds = pieces.groupBy("source").agg(F.min_by(first, F.struct("block", "place")).alias("_first"))
    # Entries of an array are one level deep; an object alone is at the top.
    level = kinds.select("source", F.when(F.col("_first") == "{", 0).otherwise(1).alias("level"))

    # The sums take figures alone; the text is shuffled when it meets its entry's number.
    began = _with_running(pieces.drop("value"), "quotes", "_quotes")
    closes = (F.col("_quotes") + F.col("quotes")) % 2 == 0
    deeper = F.when(F.col("_quotes") % 2 == 1, F.col("deeper_inside")).otherwise(F.col("deeper_outside"))
    nested = durable(began.select(*SPLIT, "place", closes.alias("closes"), deeper.alias("deeper")))
    depth = F.col("_depth") + F.col("deeper")
    ended = _with_running(nested, "deeper", "_depth").join(level, "source")
    ended = durable(
        ended.select(*SPLIT, "place", "level", depth.alias("depth"), (F.col("closes") & (depth == F.col("level"))).cast("int").alias("ends"))
    )
    numbered = _with_running(ended, "ends", "entry_no").join(_finished(ended), "source", "left_semi")
    numbered = numbered.join(pieces.select("place", "value"), "place")
    part = F.struct("block", "place", "value", "ends")
    whole = numbered.groupBy("source", "entry_no").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.first("level").alias("level"))
    return _checked(whole)


def _finished(ended: DataFrame) -> DataFrame:
    """The files, of which each must end at the top level; behind an array's end a brace was counted that isn't there."""
    place = F.struct("block", "place")
    last = ended.groupBy("source").agg(F.max_by("depth", place).alias("depth"), F.first("level").alias("level"))
    complaint = F.raise_error(F.concat(F.lit("unfinished JSON in "), F.col("source"))).cast("boolean")
    good = (F.col("depth") == -1) | ((F.col("level") == 0) & (F.col("depth") == 0))
    return last.where(F.when(good, True).otherwise(complaint)).select("source")


def _checked(whole: DataFrame) -> DataFrame:
    """The entries; what stands between and behind them must be separators, and all brackets must close."""
    last = F.element_at("parts", -1)
    text = F.concat(F.array_join(F.col("parts")["value"], "}"), F.when(last["ends"] == 1, "}").otherwise(""))
    # Behind the last entry: the end of the array.
    rest = r"^[\s\ufeff]*\[?\s*\]?\s*$"
    complaint = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), F.col("source"))).cast("string")
    first = (F.col("entry_no") == 0) & F.col("text").rlike(r"(?s)^[\s\ufeff]*\[?\s*\{.*")
    later = (F.col("entry_no") > 0) & F.col("text").rlike(r"(?s)^\s*,\s*\{.*")
    entry = (
        F.when((last["ends"] == 1) & (first | later), F.regexp_replace("text", r"^[\s\ufeff]*[\[,]?\s*", ""))
        .when(last["ends"] == 1, complaint("no object"))
        .when(F.col("text").rlike(rest) & (F.col("level") == 1), F.lit(None).cast("string"))
        .when(F.col("text").rlike(r"^\s*$") & (F.col("level") == 0), F.lit(None).cast("string"))
        .otherwise(complaint("broken JSON"))
    )
    shown = whole.withColumn("text", text).select("source", "entry_no", entry.alias("entry"))
    return shown.where("entry IS NOT NULL")
