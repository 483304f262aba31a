"""JSON area profiles, corpus fingerprints and the stored index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.runtime import durable
from hearthline.schema import AREAS
from hearthline.sources import arrays, files


def read_areas(spark: SparkSession, path: str | list[str], lines: bool = False, pattern: str = "*.json") -> DataFrame:
    """Area profiles from a file, a list of files, or every file of a folder whose name fits, with their source path.

    A file holds one array of entries, or with lines=True an entry per line; either may be of any size and is read by
    several tasks. Text that is no JSON, a value of another type, and a missing area, price range, pros or cons fail
    the job; amenities may be absent.
    """
    if lines:
        read = spark.read.schema(AREAS).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(path)
        rows = read.withColumn("source", F.col("_metadata.file_path"))
    else:
        entry = F.from_json("entry", AREAS, {"mode": "FAILFAST"}).alias("e")
        rows = arrays.entries(spark, path, pattern).select(entry, "source").select("e.*", "source")
    return rows.withColumns({c: _needed(c) for c in ("area", "hdb_price_range", "pros", "cons")})


def write_arrays(df: DataFrame, folder: str, per_file: int = 1000) -> None:
    """The rows as JSON arrays, about `per_file` in each file; files are called *.txt."""
    files_ = max(1, df.count() // per_file)
    part = F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(files_))
    entry = F.to_json(F.struct("*")).alias("entry")
    # Files are dealt out before their entries are collected, so the rows are shuffled once.
    dealt = df.select(part.alias("part"), entry).repartition(files_, "part")
    lists = dealt.groupBy("part").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    text = F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]"))
    lists.select("part", text.alias("value")).write.mode("overwrite").partitionBy("part").option("compression", "none").text(folder)


def _needed(name: str) -> Column:
    complaint = F.concat(F.lit(f"entry without '{name}' in "), F.col("source"))
    return F.coalesce(F.col(name), F.raise_error(complaint).cast(AREAS[name].dataType))


def area_names(areas: DataFrame) -> DataFrame:
    return areas.select("area")


def _combined(digests: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """One MD5 per group from per-item MD5s by addition: any order, no list of items in memory."""

    def half(start: int) -> Column:
        number = F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")
        return F.sum(number).cast("decimal(38,0)").cast("string")

    return digests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.md5(F.concat_ws("-", F.count(F.lit(1)).cast("string"), half(1), half(17))).alias("fingerprint"),
    )


def fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, items, fingerprint: changes with any value, with added and with dropped rows, not with order."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    digests = df.select(*keys, F.md5(F.concat_ws("\x1f", *shown)).alias("digest"))
    return _combined(digests, keys, "digest")


def file_fingerprint(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """items, fingerprint over the bytes and the names of files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = F.md5(F.concat_ws("\x1f", F.md5("content"), F.col("path")))
    return _combined(found.select(named.alias("digest")), [], "digest")


def stored_index(spark: SparkSession, folder: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The index for a corpus fingerprint: read if finished, else built and written.

    A rebuild removes the indexes of other fingerprints in the folder. Spark adds the
    _SUCCESS file last, so a half-written index counts as absent.
    """
    path = f"{folder}/fingerprint={mark}"
    if not files.exists(spark, path + "/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
        for other in files.children(spark, folder):
            if "/fingerprint=" in other and not other.endswith(f"/fingerprint={mark}"):
                files.remove(spark, other)
    return spark.read.parquet(path)


def kept_index(spark: SparkSession, folder: str, documents: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index of the documents, brought up to date: only documents that are new or differ since the last call are built.

    `documents` may have several rows of one key; they are one document. `build` makes index rows, which keep the key, from some of the
    documents. The folder holds, per version, a manifest with one fingerprint per document and the version its rows were
    written in, the rows written, and the keys whose earlier rows are out of date, because the document changed or is gone.
    Reading leaves those out by an anti-join. A version counts once its manifest is finished, which is written last, so
    what a lost attempt left behind is overwritten by the next one. Columns of the result: those of build, and version.
    """
    prints = fingerprint(documents, [c for c in documents.columns if c != key], [key]).select(key, "fingerprint")
    last = last_version(spark, folder)
    if last == 0:
        _write_version(spark, folder, 1, documents, prints.withColumn("version", F.lit(1)), None, build)
        return _current(spark, folder, 1)
    old = spark.read.parquet(f"{folder}/manifest/version={last}").select(
        F.col(key).alias("_key"), F.col("fingerprint").alias("_print"), F.col("written").alias("_written")
    )
    # Stored: three small tables are read off it, and the documents' texts are looked at once.
    both = durable(prints.join(old, F.col(key).eqNullSafe(F.col("_key")), "full"))
    there, was = F.col("fingerprint").isNotNull(), F.col("_print").isNotNull()
    same = there & was & (F.col("fingerprint") == F.col("_print"))
    if both.where(~same).isEmpty():
        return _current(spark, folder, last)
    version = last + 1
    manifest = both.where(there).select(key, "fingerprint", F.when(same, F.col("_written")).otherwise(version).alias("version"))
    stale = both.where(was & ~same).select(F.col("_key").alias(key), F.col("_written").alias("written"))
    changed = both.where(there & ~same).select(F.col(key).alias("_changed"))
    touched = documents.join(changed, F.col(key).eqNullSafe(F.col("_changed")), "left_semi")
    _write_version(spark, folder, version, touched, manifest, stale, build)
    return _current(spark, folder, version)


def last_version(spark: SparkSession, folder: str) -> int:
    """The newest finished version of an index; 0 if there is none."""
    found = [path.rsplit("=", 1)[1] for path in files.children(spark, f"{folder}/manifest") if "/version=" in path]
    return max((int(v) for v in found if files.exists(spark, f"{folder}/manifest/version={v}/_SUCCESS")), default=0)


def _write_version(spark, folder, version, documents, manifest, stale, build) -> None:
    def write(df: DataFrame, part: str) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{part}/version={version}")

    write(build(documents), "rows")
    key = manifest.columns[0]
    none = manifest.select(key, F.col("version").alias("written")).limit(0)
    write(none if stale is None else stale, "stale")
    write(manifest.withColumnRenamed("version", "written"), "manifest")


def _current(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The rows of all versions up to this one that no later version has put out of date."""

    def read(part: str) -> DataFrame:
        paths = [f"{folder}/{part}/version={v}" for v in range(1, version + 1)]
        return spark.read.option("basePath", f"{folder}/{part}").parquet(*paths)

    rows, stale = read("rows"), read("stale").drop("version")
    key = next(c for c in stale.columns if c != "written")
    gone = stale.withColumnRenamed(key, "_stale")
    return rows.join(gone, F.col(key).eqNullSafe(F.col("_stale")) & (F.col("version") == F.col("written")), "left_anti")
