"""Replaces that are seen whole or not at all, and numbers that one writer gets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from zealmark.session import scratch_path
from zealmark.sources import state
from zealmark.sources.claims import claim, claim_next, claimed, read_text
from zealmark.sources.files import table_exists
from zealmark.sources.versions import ReplaceConflict, VersionedTable

SCHEMA = "batchid bigint, created timestamp_ntz, v bigint"


@pytest.fixture
def batch_rows(frame):
    return lambda *rows: frame([(b, f"2024-01-{day:02d} {hour:02d}:00:00", v) for b, day, hour, v in rows], SCHEMA)


def values(table, schema):
    return sorted(tuple(r) for r in table.read(schema).select("batchid", F.dayofmonth("created"), "v").collect())


def test_a_replace_that_stops_before_the_switch_changes_nothing(spark, batch_rows):
    table = VersionedTable(spark, scratch_path(spark, "versions"), ["batchid"], "created")
    old = batch_rows((5, 1, 10, 1), (5, 2, 10, 2), (6, 1, 10, 9))
    table.replace_batches(old)
    before = values(table, old.schema)
    prepared = table.prepare(batch_rows((5, 2, 10, 3)), lambda held: held[0] == "5")
    assert values(table, old.schema) == before == [(5, 1, 1), (5, 2, 2), (6, 1, 9)]
    # the rerun starts from the old state and is seen whole
    table.replace_batches(batch_rows((5, 2, 10, 3)))
    assert values(table, old.schema) == [(5, 2, 3), (6, 1, 9)]
    # what the dead job wrote can no longer be put in place, and goes with the clearing
    with pytest.raises(ReplaceConflict):
        table.commit(prepared)
    assert table.vacuum(1) >= 2
    assert values(table, old.schema) == [(5, 2, 3), (6, 1, 9)] and table.vacuum(1) == 0


def test_named_batches_lose_days_and_rows_that_are_gone(spark, batch_rows):
    table = VersionedTable(spark, scratch_path(spark, "versions"), ["batchid"], "created")
    old = batch_rows((5, 1, 10, 1), (6, 1, 10, 9), (7, 3, 10, 4))
    table.replace_batches(old)
    table.replace_batches(batch_rows(), [5])
    assert values(table, old.schema) == [(6, 1, 9), (7, 3, 4)]
    table.drop_batches([7])
    assert values(table, old.schema) == [(6, 1, 9)]
    held = table.current()
    table.replace_batches(batch_rows((6, 2, 10, 8)))
    # a reader keeps the version it began with
    assert table.read(old.schema, at=held).first().v == 9


def test_window(spark, batch_rows):
    table = VersionedTable(spark, scratch_path(spark, "versions"), [], "created")
    old = batch_rows((1, 1, 10, 1), (1, 2, 10, 2), (1, 2, 14, 3), (1, 4, 10, 4))
    table.replace_window(old, datetime(1970, 1, 1))
    cut = datetime(2024, 1, 2, 12)
    fresh = batch_rows((2, 2, 13, 5), (2, 3, 10, 6))
    prepared = table.prepare_window(fresh, cut)
    assert len(values(table, old.schema)) == 4
    table.commit(prepared)
    expected = [(1, 1, 1), (1, 2, 2), (2, 2, 5), (2, 3, 6)]
    assert values(table, old.schema) == expected
    first_day = table.current().folders[("2024-01-01",)]
    table.replace_window(fresh, cut)
    assert values(table, old.schema) == expected
    # days before the cut are not written again
    assert table.current().folders[("2024-01-01",)] == first_day
    assert table.last_day() == datetime(2024, 1, 3)
    assert sorted(r.v for r in table.read_after(old.schema, cut).collect()) == [5, 6]
    table.replace_window(batch_rows(), cut)
    assert values(table, old.schema) == [(1, 1, 1), (1, 2, 2)]


def test_the_plan_of_a_replace_runs_once(spark, batch_rows):
    seen = spark.sparkContext.accumulator(0)
    rows = batch_rows((5, 1, 10, 1), (6, 1, 10, 9), (6, 2, 10, 3))
    schema = rows.schema

    def counted():
        def look(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(look, schema)

    VersionedTable(spark, scratch_path(spark, "versions"), ["batchid"], "created").replace_batches(counted())
    assert seen.value == 3
    state.replace_batch(counted(), scratch_path(spark, "plain"), ts_col="created")
    assert seen.value == 6


def test_an_empty_table(spark, batch_rows):
    table = VersionedTable(spark, scratch_path(spark, "versions"), ["batchid"], "created")
    schema = batch_rows().schema
    assert table.current().number == 0 and table.read(schema).count() == 0 and table.last_day() is None
    table.replace_batches(batch_rows())
    assert table.current().number == 1 and table.read_after(schema, datetime(2024, 1, 1)).count() == 0


def test_a_number_is_given_once(spark):
    root = scratch_path(spark, "claims")
    assert claim(spark, root, 1, "mine") and not claim(spark, root, 1, "theirs")
    assert read_text(spark, root, 1) == "mine" and claimed(spark, root) == [1]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: claim_next(spark, root), range(16)))
    assert sorted(got) == list(range(2, 18))


def test_runs_at_once_get_different_ids_and_no_mark_is_lost(spark):
    path = scratch_path(spark, "marks")
    marks = [state.Marks(spark, path) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        ids = list(pool.map(lambda m: m.claim_run(), marks))
    assert sorted(ids) == [1, 2]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda pair: [pair[1].advance(**{f"source{pair[0]}": n}) for n in range(6)], enumerate(marks)))
    assert marks[0].read("source0") == 5 and marks[1].read("source1") == 5
    marks[0].advance(run=3)
    assert marks[1].claim_run() == 3 and len(claimed(spark, path)) <= state.Marks.KEPT
    assert table_exists(spark, path)


def test_a_mark_never_falls(spark):
    marks = state.Marks(spark, scratch_path(spark, "marks"))
    marks.advance(views=9)
    marks.advance(views=4)
    assert marks.read("views") == 9
