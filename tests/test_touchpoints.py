"""Fan-out, flags and multiplicities of the extracts, against plain joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from zealmark.operators import touchpoints as tp
from zealmark.operators.catalog import Dims, content
from zealmark.operators.leads import new_leads
from zealmark.streaming.loads import bookmark_counts

FACT = "application_id string, global_user_id string, created timestamp_ntz, identifier string, metadata string, batch_id bigint"


@pytest.fixture(scope="module")
def dims(frame):
    return Dims(
        frame(
            [(1, "s1", 10, 0), (2, "s2", 10, 0), (3, "off", 10, 1), (4, "in closed topic", 11, 0), (8, "speaker", 20, 0), (9, "x", 30, 0)],
            "itemid bigint, name string, parenttopicid bigint, isdisabled int",
        ),
        frame([(10, 2, 0), (11, 2, 1), (20, 4, 0), (30, 3, 0)], "topicid bigint, listtypeid int, isdisabled int"),
        frame([(1, 100), (1, 101), (1, 101), (2, 999)], "itemid bigint, filterid bigint"),
        frame([(100, "red"), (101, "blue")], "filterid bigint, name string"),
        frame([(1, 8), (2, 8), (3, 8), (9, 8)], "sourceitemid bigint, targetitemid bigint"),
    )


def fact(item, identifier="item", user="U1", app="App", at="2024-01-01 10:00:00"):
    return (app, user, at, identifier, f'{{"ItemId": {item}}}', 1)


def shown(df, metric):
    return sorted(
        ((r.itemid, r.filterid, r.session_track, r[metric]) for r in df.collect()), key=lambda r: tuple(str(v) for v in r)
    )


def test_every_track_gets_full_credit_and_copies_count_twice(frame, dims):
    facts = frame([fact(1), fact(1), fact(2), fact(3), fact(9), fact(8), fact(1, "list"), fact('"x"')], FACT)
    got = tp.views(facts, content(dims))
    assert shown(got, "num_views") == [(1, 100, "red", 2), (1, 101, "blue", 4), (2, 999, None, 1)]
    assert {r.application_id for r in got.collect()} == {"app"}
    inner = tp.views(facts, content(dims, "inner"))
    assert shown(inner, "num_views") == [(1, 100, "red", 2), (1, 101, "blue", 4)]
    assert tuple(tp.rejected_item_ids(facts).first()) == (8, 1)


def test_speakers_count_for_every_linked_session(frame, dims):
    facts = frame([fact(8, "bookmarkButton"), fact(8, "bookmarkButton")], FACT)
    got = tp.speaker_bookmarks(facts, content(dims))
    assert shown(got, "num_bookmarks") == [(1, 100, "red", 2), (1, 101, "blue", 4), (2, 999, None, 2)]


def test_accounts_and_details_multiply_unless_semi(frame, dims):
    facts = frame([fact(8), fact(8, user="stranger")], FACT)
    users = frame([("u1",), ("U1",)], "globaluserid string")
    details = frame([("u1",)] * 3, "globaluserid string")
    counted = tp.speaker_views(facts, content(dims), users, details)
    assert shown(counted, "num_views") == [(1, 100, "red", 6), (1, 101, "blue", 12), (2, 999, None, 6)]
    once = tp.speaker_views(facts, content(dims), users, details, user_match="semi")
    assert shown(once, "num_views") == [(1, 100, "red", 1), (1, 101, "blue", 2), (2, 999, None, 1)]


def test_checkins_count_notes_and_look_at_the_topic_flag(frame, dims):
    schema = "checkinid bigint, userid bigint, applicationid string, itemid bigint, created timestamp_ntz"
    made = frame([(1, 7, "APP", i, "2024-01-01 10:00:00") for i in (2, 3, 4)] + [(5, 7, "APP", 2, "2024-01-01 11:00:00")], schema)
    notes = frame([(1,), (1,)], "checkinid bigint")
    users = frame([(7, "u7"), (8, "u8")], "userid bigint, globaluserid string")
    got = tp.checkins(made, notes, content(dims), users)
    assert shown(got, "num_checkins") == [(2, 999, None, 2), (3, None, None, 2)]


def test_coverage_counts_people_once_and_views_with_copies(frame, dims):
    facts = frame([fact(1), fact(1), fact(2, user="u2"), fact(4), fact(3)], FACT)
    users = frame([(1, "u1"), (2, "U2"), (3, "u2")], "userid bigint, globaluserid string")
    apps = frame([("APP", "2024-01-05 00:00:00"), ("APP", "2025-01-01 00:00:00")], "applicationid string, enddate timestamp_ntz")
    built = frame([("app",), ("aPP",)], "applicationid string")
    got = tp.audience_coverage(facts, dims, users, apps, built, "2024-01-01", "2024-02-01").collect()
    # u1: two views of s1 and one in the closed topic; u2: one view, two accounts; everything twice implemented
    assert [tuple(r) for r in got] == [("App", 3, 2 * (3 + 2))]


def test_new_leads_start_after_the_target(frame):
    person = frame([("u1", "CEO", "e", "f", "l", "c", "p")], "globaluserid string, title string, emailaddress string, firstname string, lastname string, company string, phone string")
    apps = frame([("A", "Event", "2024-01-01 00:00:00", "2024-01-02 00:00:00")], "applicationid string, name string, startdate timestamp_ntz, enddate timestamp_ntz")
    schema = "application_id string, global_user_id string, created timestamp_ntz, session_track string, itemid string, filterid string, session_name string, batchid bigint, zscore double, grade_score string"
    scores = frame([("a", "U1", "2024-01-01 00:00:00", "t", "1", "1", "n", b, 1.0, "A") for b in (1, 2, 3)], schema)
    target = scores.filter("batchid = 1")
    assert sorted(r.batchid for r in new_leads(scores, target, person, apps).collect()) == [2, 3]
    assert new_leads(scores, target.filter(F.lit(False)), person, apps).count() == 0
    assert new_leads(scores, target, person, apps).first().title == "C-Level exec"


def test_late_rows_are_counted(frame, spark):
    from zealmark.session import scratch_path
    from zealmark.streaming.loads import file_stream, run_available

    folder, out, marks = (scratch_path(spark, n) for n in ("facts", "counts", "marks"))
    for day in ("2024-01-20", "2024-01-21", "2024-01-01"):
        df = frame([fact(1, "bookmarkButton", at=f"{day} 10:00:00")], FACT)
        df.coalesce(1).write.mode("append").parquet(folder)
        run_available(file_stream(spark, folder, df.schema), out, marks, bookmark_counts)
    days = sorted(r.created.day for r in spark.read.parquet(out).collect())
    assert days == [1, 20, 21]


def test_batch_delivered_again_is_replaced(frame, spark, collected):
    from zealmark.session import scratch_path
    from zealmark.streaming.loads import file_stream, replace_available

    folder, out, marks = (scratch_path(spark, n) for n in ("facts", "table", "marks"))
    schema = "batch_id bigint, event_id bigint, metadata string"
    for rows in ([(1, 10, "a"), (1, 11, "a"), (2, 20, "a")], [(1, 10, "corrected")], [(3, 30, "a"), (2, 20, "a")]):
        frame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        replace_available(file_stream(spark, folder, schema), out, marks)
    kept = collected(spark.read.schema(schema).parquet(out), "batch_id", "event_id", "metadata")
    assert kept == [(1, 10, "corrected"), (2, 20, "a"), (3, 30, "a")]
