"""Folders of a table, through Hadoop's file systems."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark: SparkSession, path: str) -> Any:
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    return filesystem(spark, path).exists(hadoop_path(spark, path))


def partition_folders(spark: SparkSession, top: str, parts: Sequence[str]) -> list[tuple[tuple[str, ...], Any]]:
    """The partition folders under ``top`` with the values of ``parts``, as the folder names have them."""
    if not table_exists(spark, top):
        return []
    fs = filesystem(spark, top)
    level: list[tuple[tuple[str, ...], Any]] = [((), hadoop_path(spark, top))]
    for part in parts:
        below = []
        for values, folder in level:
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if status.isDirectory() and name.startswith(f"{part}="):
                    below.append(((*values, name.split("=", 1)[1]), status.getPath()))
        level = below
    return level
