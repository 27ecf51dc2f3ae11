"""Touchpoints from an arriving fact stream, and micro-batches that replace whole batches of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zealmark.operators.catalog import Content
from zealmark.operators.touchpoints import credit, item_counts
from zealmark.schemas import enforce_schema
from zealmark.session import discard, scratch_path, stage
from zealmark.sources.files import table_exists
from zealmark.sources.state import replace_batch
from zealmark.sources.versions import VersionedTable

EPOCH = "epoch"
DELIVERY = "_delivery"
DAY, FROM = "fact_day", "delivered"


def file_stream(spark: SparkSession, directory: str, schema: T.StructType | str, files: str = "*.parquet", delivery: str | None = None) -> DataFrame:
    """Rows of the files that arrive in ``directory``.

    ``delivery`` adds the column ``_delivery``: the time and the name of what a
    row came with, a "file" or, where a delivery is several files, their "folder".
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(directory)
    return stream if delivery is None else stream.select("*", _delivered(delivery).alias(DELIVERY))


def _delivered(unit: str) -> Column:
    name = F.col("_metadata.file_path")
    source = name if unit == "file" else F.regexp_extract(name, r"^(.*)/[^/]*$", 1)
    return F.struct(F.col("_metadata.file_modification_time").alias("at"), source.alias("source"))


def bookmark_counts(facts: DataFrame) -> DataFrame:
    """Bookmarks per person, time, batch and item of the facts of one micro-batch (or of a table)."""
    return item_counts(facts, "bookmarkButton")


# --- facts that stand once however often they arrive -----------------------------------------


class FactLedger:
    """Ids of the facts that have been taken in, by the day of their time, in a folder all executors share.

    A fact delivered again has its old id and time, so a micro-batch looks only at
    the days it holds itself, however late they are; nothing is ever lost for being late. What a
    micro-batch leaves is named by its feed and number: a repeated one replaces it
    and does not take its own earlier attempt for an older delivery.
    """

    def __init__(self, path: str, id_col: str = "event_id", ts_col: str = "created"):
        self.path, self.id_col, self.ts_col = path, id_col, ts_col

    def _day(self) -> Column:
        return F.date_format(self.ts_col, "yyyy-MM-dd")

    def fresh(self, facts: DataFrame, delivered: str) -> DataFrame:
        """Each fact of ``facts`` that no other delivery had, once; facts without id cannot be told apart and all stay."""
        spark, named = facts.sparkSession, F.col(self.id_col).isNotNull()
        once = facts.where(named).dropDuplicates([self.id_col])
        if table_exists(spark, self.path):
            # one row for each day
            days = [row[0] for row in facts.where(named).select(self._day()).distinct().collect()]
            fields = [T.StructField(self.id_col, facts.schema[self.id_col].dataType), T.StructField(DAY, T.StringType()), T.StructField(FROM, T.StringType())]
            known = spark.read.schema(T.StructType(fields)).parquet(self.path).where(F.col(DAY).isin(days) & (F.col(FROM) != delivered))
            once = once.join(known.select(self.id_col), self.id_col, "left_anti").select(facts.columns)
        return once.unionByName(facts.where(~named))

    def enter(self, facts: DataFrame, delivered: str) -> None:
        taken = facts.where(F.col(self.id_col).isNotNull()).select(self.id_col, self._day().alias(DAY), F.lit(delivered).alias(FROM))
        _overwrite(taken, self.path, DAY, FROM)


def _overwrite(rows: DataFrame, path: str, *parts: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def take_available(
    stream: DataFrame, path: str, checkpoint: str, ledger: FactLedger, shape: Callable[[DataFrame], DataFrame] = lambda facts: facts, feed: str = "facts"
) -> None:
    """Process what has arrived, then stop: ``shape`` of the facts that are new to ``ledger``, under ``path`` by micro-batch.

    Several feeds may share a table and its ledger, one after the other; each has a name of its own.
    """

    def write(facts: DataFrame, epoch: int) -> None:
        delivered = f"{feed}-{epoch:09d}"
        spark = facts.sparkSession
        # used for the rows and for the ledger: written once
        fresh = stage(ledger.fresh(facts, delivered), "fresh-facts")
        folder = fresh.inputFiles()
        _overwrite(shape(fresh).withColumn(FROM, F.lit(delivered)), path, FROM)
        ledger.enter(fresh, delivered)
        if folder:
            discard(spark, folder[0].rsplit("/", 1)[0])

    _run(stream, checkpoint, write)


def stream_bookmarks(facts: DataFrame, content: Content, *again: DataFrame) -> DataFrame:
    """Same rows as the batch extract, from a stream of facts in any order, and from further feeds that may repeat facts.

    Each micro-batch leaves the counts of the facts that are new, and the counts are
    added up when they are read, so no late row is lost and none counts twice. Sessions and tracks are
    joined to the counts afterwards.
    """
    spark = facts.sparkSession
    path, ledger = scratch_path(spark, "stream-counts"), FactLedger(scratch_path(spark, "stream-ledger"))
    for n, feed in enumerate((facts, *again)):
        take_available(feed, path, scratch_path(spark, "stream-marks"), ledger, bookmark_counts, f"feed{n}")
    return credited_bookmarks(spark, path, bookmark_counts(facts).schema, content)


def credited_bookmarks(spark: SparkSession, path: str, counted: T.StructType, content: Content) -> DataFrame:
    """The extract of the counts that the micro-batches have left under ``path`` so far."""
    keys = ["application_id", "global_user_id", "created", "batchid", "itemid"]
    counts = read_epochs(spark, path, T.StructType([*counted.fields, T.StructField(FROM, T.StringType())]))
    enabled = content.sessions.filter("item_off = 0")
    credited = credit(counts.groupBy(*keys).agg(F.sum("n").alias("n")), enabled, "itemid", "sum(n * fanout)", "num_bookmarks")
    return enforce_schema(credited, "sessions_bookmarked")


# --- batches that arrive whole -----------------------------------------------------------------


def newest_deliveries(rows: DataFrame, batch_col: str) -> DataFrame:
    """Of each batch the rows of its newest delivery alone, without the ``_delivery`` column.

    A delivery is as old as its newest file; of equal times the later name counts as newer.
    """
    source, batch = F.col(f"{DELIVERY}.source"), F.col(batch_col)
    timed = rows.groupBy(batch.alias("_batch"), source.alias("_source")).agg(F.max(f"{DELIVERY}.at").alias("_at"))
    # one row for each batch
    newest = timed.groupBy("_batch").agg(F.max_by("_source", F.struct("_at", "_source")).alias("_source"))
    kept = rows.join(newest, batch.eqNullSafe(F.col("_batch")) & (source == F.col("_source")), "left_semi")
    return kept.drop(DELIVERY)


def _into_batches(path: str, batch_col: str, versioned: bool):
    """Writer of a micro-batch's rows that replaces the batches they are of, so a batch delivered again stands once."""

    def write(rows: DataFrame, epoch: int) -> None:
        newest = newest_deliveries(rows, batch_col) if DELIVERY in rows.columns else rows
        if versioned:
            VersionedTable(rows.sparkSession, path, [batch_col]).replace_batches(newest)
        else:
            replace_batch(newest, path, batch_col)

    return write


def _into_epoch(path: str, shape: Callable[[DataFrame], DataFrame]):
    """Writer of a micro-batch's rows, as ``shape`` makes them, into its own partition; a repeated delivery replaces it."""

    def write(batch: DataFrame, epoch: int) -> None:
        _overwrite(shape(batch).withColumn(EPOCH, F.lit(epoch).cast("bigint")), path, EPOCH)

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> None:
    """Process what has arrived, then stop. Facts that arrive twice are two rows; ``take_available`` tells them apart."""
    _run(stream, checkpoint, _into_epoch(path, shape))


def replace_available(stream: DataFrame, path: str, checkpoint: str, batch_col: str = "batch_id", versioned: bool = False) -> None:
    """Put what has arrived into the table at ``path``, split by batch, then stop: the newest delivery of a batch is what stays.

    A ``versioned`` table changes in one step and is read by ``read_batches``; a plain one
    is read like any folder, folder by folder as they are exchanged.

    A delivery holds its batches whole; facts that trickle in belong into
    ``take_available``. Of several deliveries of a batch before one run the newest counts if the stream says what
    each row came with (``file_stream(delivery=…)``); a later run counts as newer than an earlier one. A stream with a rate limit
    (``maxFilesPerTrigger``) must not cut a delivery.
    """
    _run(stream, checkpoint, _into_batches(path, batch_col, versioned))


def _run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_epochs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What has arrived so far; empty before the first micro-batch."""
    return spark.read.schema(schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, path: str, schema: T.StructType, batch_col: str = "batch_id") -> DataFrame:
    return VersionedTable(spark, path, [batch_col]).read(schema)


def stream_batch_replace(*deliveries: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Table of the newest delivery of each batch, from streams that arrive one after the other."""
    first = deliveries[0]
    spark = first.sparkSession
    path = scratch_path(spark, "stream-table")
    for stream in deliveries:
        replace_available(stream, path, scratch_path(spark, "stream-marks"), batch_col, versioned=True)
    return read_batches(spark, path, first.schema, batch_col).select(first.columns)
