"""Folders of the shared file system, through the same file system classes that Spark's readers use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _on(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _on(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, files = _on(spark, path)
    files.delete(target, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    target, files = _on(spark, path)
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none if there is no such folder."""
    target, files = _on(spark, path)
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))
