"""Session settings and the folder that every executor can reach."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from hearthline.sources import files


def session(app: str = "hearthline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the jobs rely on; `settings` win over the defaults.

    Shuffle width is left to AQE: start wide, let it merge small partitions and
    split skewed ones. Keyword names use `__` for the dots of a Spark setting.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update({k.replace("__", "."): v for k, v in settings.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where jobs may write tables for later stages.

    The cluster names it in spark.checkpoint.dir. A temporary folder stands in
    for it only in local mode, where one machine holds everything.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = "file:" + tempfile.mkdtemp(prefix="hearthline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def workspace(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/hearthline/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, **options: str) -> DataFrame:
    """The frame written to the shared folder and read back.

    For small results that later steps use more than once: they are computed once, a lost
    executor does not bring the work back, and the planner knows the true size, so that it
    broadcasts the table when it is small and shuffles it when it is not.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/steps/{uuid4().hex}"
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def durable_by(df: DataFrame, column: str) -> DataFrame:
    """durable(), in buckets by a column's hash: joins on that column do not shuffle the stored rows again.

    Rows should come with equal hashes together, as after a shuffle by that column, so that there is about one file per bucket.
    The catalog names the table only until it has been read back.
    """
    spark = df.sparkSession
    name = f"step_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", f"{workspace(spark)}/steps/{name}").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def finish(spark: SparkSession) -> None:
    """Removes what this application stored for itself and ends the session."""
    files.remove(spark, workspace(spark))
    spark.stop()


def side_by_side(spark: SparkSession, *makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """The frames of several makers whose first passes do not depend on each other and run at the same time."""
    with ThreadPoolExecutor(len(makers)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(make)) for make in makers]
        return [job.result() for job in running]
