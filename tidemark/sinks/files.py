"""Folders of a table, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def numbered(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers n of the folders ``key=n`` below ``path``, ascending."""
    return sorted(int(n.removeprefix(f"{key}=")) for n in names(spark, path) if n.startswith(f"{key}="))


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, there at once or not at all."""
    fs, place = _at(spark, path)
    fs.create(place, True).close()
