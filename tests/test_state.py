"""Marks, replaces, contracts and the incremental lead run."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from zealmark.plans.leads_job import LeadsJob, Sources
from zealmark.plans.registry import sources
from zealmark.schemas import TABLES, SchemaMismatch, enforce_schema
from zealmark.session import scratch_dir, scratch_path
from zealmark.sources import state, tables
from zealmark.sources.fixtures import Platform

SF = "/root/testdata/sf0.001"


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_since_is_strict_below_and_inclusive_above(frame, collected):
    df = frame([(1,), (2,), (3,), (4,)], "batch_id bigint")
    assert collected(state.since(df, "batch_id", 1, 3)) == [(2,), (3,)]


def test_no_mark_loads_nothing_unless_bootstrapped(frame):
    df = frame([(1,), (2,)], "batch_id bigint")
    assert state.since(df, "batch_id", None).count() == 0
    assert state.since(df, "batch_id", None, bootstrap=True).count() == 2
    assert state.since(df, "batch_id", None, 1, bootstrap=True).count() == 1


def test_current_batch(frame, collected):
    df = frame([("a", 1), ("b", 2), ("c", 2)], "x string, batchid bigint")
    assert collected(state.current_batch(df), "x") == [("b",), ("c",)]
    assert state.current_batch(df.filter(F.lit(False))).count() == 0


def test_marks(spark):
    marks = state.Marks(spark, scratch_path(spark, "marks"))
    assert marks.read("views") is None and marks.next_run() == 1
    marks.advance(views=5, run=2)
    marks.advance(views=9)
    assert marks.read("views") == 9 and marks.next_run() == 2


def test_replace_batch_touches_only_its_batches(frame, spark, collected):
    path = scratch_path(spark, "batches")
    schema = "x string, batchid bigint"
    state.replace_batch(frame([("a", 1), ("b", 2)], schema), path)
    for _ in range(2):
        state.replace_batch(frame([("c", 2)], schema), path)
    assert collected(spark.read.parquet(path).select("x", "batchid")) == [("a", 1), ("c", 2)]


def test_replace_window(frame, spark, collected):
    schema = "x string, created timestamp_ntz"
    df = frame([], schema)
    path = scratch_path(spark, "window")
    old = [
        ("before", "2024-01-01 00:00:00"),
        ("edge", "2024-01-02 12:00:00"),
        ("cut day, late", "2024-01-02 12:00:01"),
        ("gone day", "2024-01-04 00:00:00"),
    ]
    cut = datetime(2024, 1, 2, 12)
    state.replace_window(spark, path, frame(old, schema), "created", cut)
    fresh = frame([("new", "2024-01-03 00:00:00"), ("new, cut day", "2024-01-02 13:00:00")], schema)
    expected = [("before",), ("edge",), ("new",), ("new, cut day",)]
    for _ in range(2):
        state.replace_window(spark, path, fresh, "created", cut)
        assert collected(state.read_dated(spark, path, df.schema), "x") == expected
    assert collected(state.windowed(frame(old, schema), fresh, "created", cut), "x") == expected
    state.replace_window(spark, path, frame([], schema), "created", cut)
    assert collected(state.read_dated(spark, path, df.schema), "x") == [("before",), ("edge",)]


def test_contract(frame):
    df = frame([("a", 1)], "body string, extra int")
    with pytest.raises(SchemaMismatch, match="application_id"):
        enforce_schema(df, "chat_responses")
    fixed = enforce_schema(df.withColumn("application_id", F.lit(7)), "chat_responses")
    assert fixed.schema == TABLES["chat_responses"] or fixed.columns == ["application_id", "body"]
    assert fixed.first()[0] == "7"


def test_csv_and_json_round_trips(frame, spark, collected):
    pairs = frame([(0.5, 0.25), (None, 1.0)], "svd_social double, svd_content double")
    path = scratch_path(spark, "csv")
    tables.write_csv(pairs, path)
    assert collected(tables.read_csv(spark, path)) == collected(pairs)
    assert tables.read_csv(spark, path, "score_pairs").schema == TABLES["score_pairs"]
    replies = frame([("a", 'say "hi"\n'), ("b", None)], "application_id string, body string")
    path = scratch_path(spark, "json")
    tables.write_json(replies, path)
    assert collected(tables.read_json(spark, path, "chat_responses")) == collected(replies)


def test_load_checks_the_contract(frame, spark):
    root = scratch_path(spark, "root")
    tables.overwrite(frame([("a", "1")], "application_id string, body string"), f"{root}/replies", "chat_responses")
    assert tables.load(spark, root, "replies", "chat_responses").count() == 1
    assert tables.load(spark, SF, "region").count() == 5


def facts_up_to(src: Sources, batch: int) -> Sources:
    seen = F.col("batch_id") <= batch
    checkins = src.checkins.filter(F.dayofmonth("created") <= batch)
    return Sources(
        src.actions.filter(seen),
        src.views.filter(seen),
        src.session_events.filter(seen),
        checkins,
        src.checkin_notes,
        src.users,
        src.details,
        src.applications,
        src.dims,
    )


def test_lead_run_in_two_loads(spark, collected):
    """A run over everything equals two runs that load one after the other, as far as loads are concerned."""
    src = sources(Platform(spark, SF))
    root = scratch_path(spark, "job")
    first = LeadsJob(spark, facts_up_to(src, 28), root)
    assert first.run("2024-01-29 00:00:00", 240) == 1
    second = LeadsJob(spark, src, root)
    assert second.run("2024-01-31 00:00:00", 240) == 2
    whole = LeadsJob(spark, src, scratch_path(spark, "job"))
    whole.load_touchpoints()
    for table in ("sessions_bookmarked", "sessions_viewed", "sessions_checkins_status", "sessions_speakers_viewed"):
        assert collected(second.table(table)) == collected(whole.table(table))
    assert {r.batchid for r in second.table("leads").select("batchid").distinct().collect()} == {1, 2}
    # a repeated score step replaces its batch
    before = collected(second.table("scores").filter("batchid = 2"))
    second.marks = state.Marks(spark, scratch_path(spark, "marks"))
    second.marks.advance(run=2)
    assert second.score("2024-01-31 00:00:00", 240) == 2
    assert collected(second.table("scores").filter("batchid = 2")) == before
    assert second.table("scores").filter("batchid = 2").count() == second.table("actions_stag").filter("batchid = 2").count()


def batch_rows(frame, *rows):
    return frame([(b, f"2024-01-{day:02d} 10:00:00", v) for b, day, v in rows], "batchid bigint, created timestamp_ntz, v bigint")


def test_replaced_batch_loses_days_and_rows_that_are_gone(frame, spark):
    path = scratch_path(spark, "batches")
    state.replace_batch(batch_rows(frame, (5, 1, 1), (5, 2, 2), (6, 1, 9)), path, ts_col="created")
    state.replace_batch(batch_rows(frame, (5, 2, 3)), path, ts_col="created")
    assert sorted((r.batchid, r.v) for r in spark.read.parquet(path).collect()) == [(5, 3), (6, 9)]
    state.replace_batch(batch_rows(frame), path, ts_col="created", batches=[5])
    assert sorted((r.batchid, r.v) for r in spark.read.parquet(path).collect()) == [(6, 9)]
    plain = scratch_path(spark, "batches")
    state.replace_batch(batch_rows(frame, (1, 1, 1), (2, 1, 2)), plain)
    state.replace_batch(batch_rows(frame), plain, batches=[2])
    assert [r.batchid for r in spark.read.parquet(plain).collect()] == [1]


def test_job_scratch_deletes_only_what_its_job_staged(frame, spark):
    from zealmark.session import job_scratch, stage

    outside = stage(frame([(1,)], "a int"), "outside")
    with job_scratch(spark):
        inside = stage(frame([(2,)], "a int"), "inside")
        assert inside.count() == 1
    assert outside.count() == 1
    assert not state.table_exists(spark, inside.inputFiles()[0])
