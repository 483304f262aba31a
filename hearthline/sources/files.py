"""The few file-system calls that DataFrame readers and writers do not cover."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _open(spark, path)
    return system.exists(where)


def children(spark: SparkSession, folder: str) -> list[str]:
    system, where = _open(spark, folder)
    return [status.getPath().toString() for status in system.listStatus(where)] if system.exists(where) else []


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or folder; the folder above the new name is made if need be."""
    system, where = _open(spark, path)
    _, target = _open(spark, to)
    system.mkdirs(target.getParent())
    system.rename(where, target)


def remove(spark: SparkSession, path: str) -> None:
    system, where = _open(spark, path)
    system.delete(where, True)


def mark(spark: SparkSession, path: str) -> str:
    """Name, size and change times of a file or of the files of a folder: differs when they change."""
    system, where = _open(spark, path)
    found = sorted(system.listStatus(where), key=lambda status: status.getPath().toString())
    return ";".join(f"{s.getPath()},{s.getLen()},{s.getModificationTime()}" for s in found)
