"""Folders on the file system of a path, whatever it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was ever written; asks the file system for one name, lists nothing."""
    system, target = file_system(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it does not exist."""
    system, target = file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def drop_folder(spark: SparkSession, path: str, values: dict[str, str | None]) -> None:
    """Remove the folder of partition values, given as text from the outermost column on."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    names = [f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else escape(v)}" for c, v in values.items()]
    remove(spark, "/".join([path, *names]))
