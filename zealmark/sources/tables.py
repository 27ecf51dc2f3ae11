"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zealmark.schemas import TABLES, enforce_schema
from zealmark.sources.state import table_exists


def load(spark: SparkSession, directory: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table ``directory/name`` or ``directory/name.parquet``, checked against its contract."""
    base = f"{directory.rstrip('/')}/{name}"
    df = spark.read.parquet(base if table_exists(spark, base) else f"{base}.parquet")
    return enforce_schema(df, schema) if schema is not None else df


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Table of a live relational database, read in parallel ranges of ``split_on``.

    Filters and column lists are pushed into the database by Spark.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on:
        if bounds is None:
            raise ValueError("split_on needs the bounds of its values, else one task reads nearly all rows")
        low, high = bounds
        reader = reader.options(
            partitionColumn=split_on, lowerBound=str(low), upperBound=str(high), numPartitions=str(num_partitions)
        )
    return reader.load()


def append(df: DataFrame, path: str, schema: T.StructType | str, partition_by: str | None = None) -> None:
    """Append by column name."""
    writer = enforce_schema(df, schema).write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def overwrite(df: DataFrame, path: str, schema: T.StructType | str | None = None) -> None:
    """Replace the whole table."""
    (enforce_schema(df, schema) if schema is not None else df).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; types are inferred where no schema is given (one more pass over the files)."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(TABLES[schema] if isinstance(schema, str) else schema).csv(path)


def as_json_lines(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row, so that no executor ever holds the whole array."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    as_json_lines(df, "value").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(TABLES[schema] if isinstance(schema, str) else schema).json(path)
