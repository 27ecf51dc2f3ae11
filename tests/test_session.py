"""What goes through the driver, by its unfolded size and not by the bytes of files; jobs that run at once."""

from __future__ import annotations

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from zealmark.plans import leads_job
from zealmark.plans.leads_job import TARGETS, LeadsJob, Sources
from zealmark.schemas import TABLES
from zealmark.session import scratch_path, side_by_side, stage, tune
from zealmark.sources.versions import VersionedTable


def _joined_plan(spark, rows, dim):
    joined = rows.join(dim, "key")
    counted = joined.agg(F.count("text"))
    found = counted.collect()[0][0]
    return found, counted._jdf.queryExecution().executedPlan().toString()


def test_a_side_that_unfolds_is_not_broadcast(spark):
    tune(spark)
    rows = stage(spark.range(0, 400_000).withColumnRenamed("id", "key"), "rows")
    dim = stage(spark.range(0, 200_000).select(F.col("id").alias("key"), F.lit("x" * 200).alias("text")), "dim")
    found, plan = _joined_plan(spark, rows, dim)
    assert found == 200_000
    assert "BroadcastExchange" not in plan.split("== Initial Plan ==")[0]


def test_a_small_side_is_broadcast(spark):
    tune(spark)
    rows = stage(spark.range(0, 400_000).withColumnRenamed("id", "key"), "rows")
    dim = stage(spark.range(0, 20).select(F.col("id").alias("key"), F.lit("x" * 200).alias("text")), "dim")
    found, plan = _joined_plan(spark, rows, dim)
    assert found == 20
    assert "BroadcastExchange" in plan


def test_an_error_is_raised_when_all_have_ended():
    ended = threading.Event()

    def fails():
        raise KeyError("first")

    def ends():
        ended.wait(0.2)
        ended.set()
        return 2

    with pytest.raises(KeyError, match="first"):
        side_by_side([fails, ends])
    assert ended.is_set()
    assert side_by_side([lambda: 1, lambda: 2]) == [1, 2]


def test_replaces_of_a_load_run_at_once_and_marks_follow(spark, frame, monkeypatch):
    facts = frame([(3,), (4,)], "batch_id bigint")
    checkins = frame([("2024-01-01 00:00:00",)], "created timestamp_ntz")
    job = LeadsJob(spark, Sources(facts, facts, facts, checkins, *[None] * 5), scratch_path(spark, "job"))
    monkeypatch.setattr(leads_job, "extracts", lambda src, hot_rows: {name: spark.createDataFrame([], TABLES[table]) for name, (table, _) in TARGETS.items()})
    # each replace waits until all the others have begun
    together, replaced = threading.Barrier(len(TARGETS), timeout=20), []

    def replace(table, rows, what):
        assert job.marks.read("actions") is None
        together.wait()
        replaced.append((table.path.rsplit("/", 1)[1], what))

    monkeypatch.setattr(VersionedTable, "replace_batches", replace)
    monkeypatch.setattr(VersionedTable, "replace_window", replace)
    job.load_touchpoints()
    assert sorted(replaced) == sorted((table, [3, 4] if batch else datetime(1970, 1, 1)) for table, batch in TARGETS.values())
    assert job.marks.read("actions") == 4
