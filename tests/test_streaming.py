"""Facts and batches that are delivered more than once."""

from __future__ import annotations

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from zealmark.session import scratch_path
from zealmark.sources import tables
from zealmark.streaming.loads import FROM, FactLedger, bookmark_counts, file_stream, read_batches, replace_available, take_available

FACTS = "application_id string, global_user_id string, created timestamp_ntz, identifier string, metadata string, batch_id bigint, event_id bigint"


def local(path: str) -> str:
    return path.removeprefix("file:")


@pytest.fixture
def facts(frame):
    def make(*events):
        return frame([("a", f"u{e % 3}", f"2024-01-{day:02d} 10:00:00", "bookmarkButton", '{"ItemId": 7}', 1, e) for e, day in events], FACTS)

    return make


class Feed:
    """A folder of arriving files, and the table its facts are taken into."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.arrived = spark, schema, scratch_path(spark, "arrived")
        self.path, self.marks = scratch_path(spark, "counts"), scratch_path(spark, "marks")
        self.ledger = FactLedger(scratch_path(spark, "ledger"))
        os.makedirs(local(self.arrived))

    def deliver(self, rows, name):
        tables.overwrite(rows.coalesce(1), f"{self.arrived}-new")
        folder = local(f"{self.arrived}-new")
        part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
        shutil.copy(f"{folder}/{part}", f"{local(self.arrived)}/{name}.parquet")

    def run(self, shape=bookmark_counts):
        take_available(file_stream(self.spark, self.arrived, self.schema), self.path, self.marks, self.ledger, shape)

    def counted(self):
        return self.spark.read.parquet(self.path).agg(F.sum("n")).first()[0]


def test_a_file_that_arrives_again_counts_once(spark, facts):
    rows = facts((1, 1), (2, 1), (3, 2))
    feed = Feed(spark, rows.schema)
    feed.deliver(rows, "one")
    feed.deliver(rows, "one-again")  # before the first run
    feed.run()
    assert feed.counted() == 3
    feed.deliver(rows, "one-a-third-time")
    feed.deliver(facts((3, 2), (4, 1)), "late")  # a late fact beside a known one
    feed.run()
    feed.run()
    assert feed.counted() == 4


def test_facts_without_id_all_stay(spark, facts):
    rows = facts((1, 1)).withColumn("event_id", F.lit(None).cast("bigint"))
    feed = Feed(spark, rows.schema)
    feed.deliver(rows.unionByName(rows), "one")
    feed.run()
    assert feed.counted() == 2


def test_a_run_that_dies_between_rows_and_ledger_is_repeated_whole(spark, facts):
    rows = facts((1, 1), (2, 2))
    feed = Feed(spark, rows.schema)
    feed.deliver(rows, "one")
    enter = feed.ledger.enter

    def dies(*_):
        raise RuntimeError("executor lost")

    feed.ledger.enter = dies
    with pytest.raises(Exception, match="executor lost"):
        feed.run()
    feed.ledger.enter = enter
    feed.run()
    assert feed.counted() == 2 and spark.read.parquet(feed.path).select(FROM).distinct().count() == 1
    feed.run()
    assert feed.counted() == 2


def test_the_newer_of_two_deliveries_before_one_run_wins(spark, frame):
    schema = "batch_id bigint, x string"
    arrived, path, marks = (scratch_path(spark, name) for name in ("arrived", "table", "marks"))
    # the older delivery has the later name, more rows and several files
    tables.overwrite(frame([(1, "old"), (1, "old too"), (2, "kept")], schema).repartition(3), f"{arrived}/z")
    time.sleep(0.05)
    tables.overwrite(frame([(1, "new"), (1, "newer"), (None, "no batch")], schema).repartition(2), f"{arrived}/a")

    def run():
        stream = file_stream(spark, f"{arrived}/*", frame([], schema).schema, delivery="folder")
        replace_available(stream, path, marks, versioned=True)
        return sorted(r.x for r in read_batches(spark, path, frame([], schema).schema).collect())

    assert run() == ["kept", "new", "newer", "no batch"]
    tables.overwrite(frame([(2, "last")], schema), f"{arrived}/b")
    assert run() == run() == ["last", "new", "newer", "no batch"]
