"""Folders and marker files through Spark's own view of storage, so that any store it can reach will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    """The file system of a path, the default one where it names none, and the path for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system spelled out, for those who open it outside Spark."""
    system, place = _open(spark, path)
    return system.makeQualified(place).toString()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if it does not exist."""
    system, place = _open(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _open(spark, path)
    return system.exists(place)


def mark(spark: SparkSession, path: str) -> bool:
    """Make an empty file; false if it was there already.  It is there as a whole or not at all."""
    system, place = _open(spark, path)
    system.mkdirs(place.getParent())
    return system.createNewFile(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _open(spark, path)
    system.delete(place, True)
