"""Load marks and repeatable replaces of table parts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zealmark.functions.columns import moment
from zealmark.session import stage
from zealmark.sources.claims import claim, claim_next, claimed, drop_claims, read_text
from zealmark.sources.files import filesystem, hadoop_path, partition_folders, table_exists

CREATED_DATE = "created_date"


# --- marks ---------------------------------------------------------------------------------


def high_water(df: DataFrame, column: str) -> Any:
    """Highest value of ``column``: one row to the driver."""
    return df.agg(F.max(column)).first()[0]


def _constant(value: Any):
    return moment(value) if isinstance(value, datetime) else F.lit(value)


def since(df: DataFrame, column: str, low: Any, high: Any = None, bootstrap: bool = False) -> DataFrame:
    """Rows after the mark ``low`` (strictly) and up to ``high`` (inclusive, where given).

    The bounds are literals, so they prune partitions and row groups. An empty
    target has no mark and loads nothing, as a comparison with NULL would;
    ``bootstrap=True`` loads everything instead.
    """
    if low is None and not bootstrap:
        return df.limit(0)
    if low is not None:
        df = df.filter(F.col(column) > _constant(low))
    if high is not None:
        df = df.filter(F.col(column) <= _constant(high))
    return df


def current_batch(df: DataFrame, column: str = "batchid") -> DataFrame:
    """Rows of the newest batch; the batch id becomes a literal, so only its partition is read."""
    newest = high_water(df, column)
    return df.limit(0) if newest is None else df.filter(F.col(column) == F.lit(newest))


class Marks:
    """Marks by source, as numbered files of which the newest holds them all.

    Each change is the next number, which one writer gets; who comes second reads
    the first one's marks and tries again, so no change is lost. Old files are deleted.
    """

    KEPT = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> tuple[int, dict[str, int]]:
        while True:
            newest = max(claimed(self.spark, self.path), default=0)
            try:
                return newest, json.loads(read_text(self.spark, self.path, newest)) if newest else {}
            except Exception:
                # folded meanwhile by other writers; there is a newer one then
                if max(claimed(self.spark, self.path), default=0) == newest:
                    raise

    def read(self, source: str) -> int | None:
        return self._all()[1].get(source)

    def advance(self, **marks: int) -> None:
        """Raise marks. Called after the tables they describe are written, so a failed run repeats."""
        while True:
            newest, held = self._all()
            raised = held | {source: max(mark, held.get(source, mark)) for source, mark in marks.items()}
            if claim(self.spark, self.path, newest + 1, json.dumps(raised)):
                drop_claims(self.spark, self.path, newest + 1 - self.KEPT)
                return

    def next_run(self, source: str = "run", first: int = 1) -> int:
        """Id of the run under way; ``advance(run=id + 1)`` ends it."""
        return self.read(source) or first

    def claim_run(self, source: str = "run", first: int = 1) -> int:
        """Id for a run that begins: of runs that begin at once, each gets its own. The id of a run that failed is not given again."""
        root = f"{self.path}/_{source}_ids"
        run = claim_next(self.spark, root, self.next_run(source, first))
        drop_claims(self.spark, root, run - self.KEPT)
        return run


# --- replaces ------------------------------------------------------------------------------


def windowed(existing: DataFrame, new: DataFrame, ts_col: str, cut: Any) -> DataFrame:
    """Rows up to ``cut`` as they are, later ones replaced by ``new``."""
    return existing.filter(F.col(ts_col) <= _constant(cut)).unionByName(new)


def sized_files(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Lay rows out by the partition they are written to.

    AQE cuts a large partition into tasks of the advisory size and merges small
    ones, so a table gets neither one file per task and partition nor one task
    that writes a whole batch.
    """
    return df.hint("rebalance", *partition_cols)


def replace_batch(
    df: DataFrame, path: str, batch_col: str = "batchid", ts_col: str | None = None, batches: Sequence[int] | None = None
) -> None:
    """Replace ``batches`` (without them those present in ``df``); running it again changes nothing.

    A batch that has lost all its rows, or all of a day, loses its old files too.

    With ``ts_col`` each batch is also split by the day of that time, so that a
    look back over a few days opens no older file.
    """
    parts = [batch_col]
    if ts_col:
        df, parts = df.withColumn(CREATED_DATE, F.col(ts_col).cast("date")), [batch_col, CREATED_DATE]
    spark, fs = df.sparkSession, filesystem(df.sparkSession, path)
    # the plan runs once; the folders that it leaves say which partitions there are
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    sized_files(df, *parts).write.partitionBy(*parts).parquet(staging)
    fresh = dict(partition_folders(spark, staging, parts))
    for values, folder in fresh.items():
        place = hadoop_path(spark, "/".join([path, *(f"{part}={value}" for part, value in zip(parts, values))]))
        fs.delete(place, True)
        fs.mkdirs(place.getParent())
        if not fs.rename(folder, place):
            raise OSError(f"cannot move {folder}")
    fs.delete(hadoop_path(spark, staging), True)
    replaced = {str(b) for b in batches} if batches is not None else {values[0] for values in fresh}
    held = {values[0] for values in fresh}
    drop_batches(spark, path, sorted(replaced - held), batch_col)
    for values, folder in partition_folders(spark, path, parts) if ts_col else ():
        if values[0] in replaced and values not in fresh:
            fs.delete(folder, True)


def drop_batches(spark: SparkSession, path: str, batches: Sequence[int | str], batch_col: str = "batchid") -> None:
    """Delete whole batches from the table at ``path``."""
    for batch in batches:
        folder = f"{path}/{batch_col}={batch}"
        if table_exists(spark, folder):
            filesystem(spark, path).delete(hadoop_path(spark, folder), True)


def replace_window(spark: SparkSession, path: str, new: DataFrame, ts_col: str, cut: datetime) -> None:
    """Delete rows after ``cut`` from the table at ``path`` and append ``new``.

    The table is partitioned by day, so only the days from the cut onwards are
    written: history is neither read nor rewritten. The day that holds the cut
    keeps its earlier rows; days that lose all their rows are dropped.
    """
    new = new.withColumn(CREATED_DATE, F.col(ts_col).cast("date"))
    if not table_exists(spark, path):
        sized_files(new, CREATED_DATE).write.partitionBy(CREATED_DATE).parquet(path)
        return
    fields = new.schema
    table = spark.read.schema(fields).parquet(path)
    edge = F.lit(cut.date().isoformat()).cast("date")
    kept = table.filter((F.col(CREATED_DATE) == edge) & (F.col(ts_col) <= _constant(cut)))
    # staged, so that the overwritten day is not read while it is replaced
    fresh = stage(kept.unionByName(new), "window")
    (
        sized_files(fresh, CREATED_DATE)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(CREATED_DATE)
        .parquet(path)
    )
    written = {str(r[0]) for r in fresh.select(CREATED_DATE).distinct().collect()}  # one row per day after the cut
    for day, folder in _days(spark, path):
        if day >= cut.date().isoformat() and day not in written:
            filesystem(spark, path).delete(folder, True)


def read_dated(spark: SparkSession, path: str, schema: T.StructType, after: datetime | None = None, ts_col: str = "created") -> DataFrame:
    """Table split by day, without its partition column; ``after`` opens only the days from that time on."""
    dated = spark.read.schema(T.StructType([*schema.fields, T.StructField(CREATED_DATE, T.DateType())])).parquet(path)
    if after is not None:
        edge = F.lit(after.date().isoformat()).cast("date")
        dated = dated.filter((F.col(CREATED_DATE) >= edge) & (F.col(ts_col) > _constant(after)))
    return dated.select([f.name for f in schema])


def _days(spark: SparkSession, path: str) -> list[tuple[str, Any]]:
    found = []
    for status in filesystem(spark, path).listStatus(hadoop_path(spark, path)):
        name = status.getPath().getName()
        if name.startswith(f"{CREATED_DATE}=2") or name.startswith(f"{CREATED_DATE}=1"):  # not the NULL partition
            found.append((name.split("=", 1)[1], status.getPath()))
    return found


def last_day(spark: SparkSession, path: str) -> datetime | None:
    """Newest day of a table split by day, from its folder names."""
    days = [day for day, _ in _days(spark, path)] if table_exists(spark, path) else []
    return datetime.fromisoformat(max(days)) if days else None
