"""Pairs, missing keys and times of the combine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from zealmark.operators.combine import combine, combine_stages, stamp_actions, touchpoint

EXTRACT = (
    "application_id string, global_user_id string, created timestamp_ntz, session_track string, {0} bigint, "
    "itemid bigint, filterid bigint, session_name string"
)
CUT = "2024-01-01 00:00:00"


def side(frame, rows, metric, **options):
    df = frame(rows, EXTRACT.format(metric))
    return touchpoint(df, metric, metric, F.lit(CUT).cast("timestamp_ntz"), **options)


def row(day, value, track="t", item=1, filterid=1, app="a", user="u"):
    return (app, user, f"2024-01-{day:02d} 00:00:00", track, value, item, filterid, "name")


def first_stage(frame, left, right):
    return combine(
        side(frame, left, "num_bookmarks"), side(frame, right, "num_checkins"), "num_checkins", [], "full", ("num_bookmarks",)
    )


def pick(df):
    return sorted(
        [(r.created.day, r.num_bookmarks, r.num_checkins) for r in df.collect()], key=lambda r: tuple(str(v) for v in r)
    )


def test_missing_track_does_not_match(frame):
    got = first_stage(frame, [row(2, 1, None, filterid=None)], [row(3, 1, None, filterid=None)])
    assert pick(got) == [(2, 1, None), (3, None, 1)]


def test_each_pair_counts_at_its_earlier_time(frame):
    got = first_stage(frame, [row(2, 1), row(5, 10)], [row(3, 1), row(4, 2), row(6, 4)])
    # (2,3) (2,4) (2,6) fall on day 2; (5,3) on 3; (5,4) on 4; (5,6) on 5
    assert pick(got) == [(2, 3, 7), (3, 10, 1), (4, 10, 2), (5, 10, 4)]


def test_case_of_application_user_and_track_is_ignored_and_left_values_shown(frame):
    got = first_stage(frame, [row(2, 1, "Track", app="a", user="U1")], [row(2, 1, "tracK", app="A", user="u1")]).collect()
    assert [(r.application_id, r.global_user_id, r.session_track) for r in got] == [("a", "U1", "Track")]


def test_unmatched_right_application_is_lowercased(frame):
    got = first_stage(frame, [row(2, 1, item=2)], [row(2, 1, app="APP")]).collect()
    assert sorted(r.application_id for r in got) == ["a", "app"]


def test_old_rows_do_not_enter(frame):
    old = ("a", "u", CUT, "t", 1, 1, 1, "name")
    assert side(frame, [old, row(2, 1)], "num_bookmarks").count() == 1


def test_single_views_do_not_enter(frame):
    assert side(frame, [row(2, 1), row(2, 2)], "num_views", min_value=2).count() == 1


def test_carried_metrics_stay_apart(frame):
    left = first_stage(frame, [row(2, 1), row(3, 5)], [])
    right = side(frame, [row(2, 2)], "speakers_bookmarked")
    got = combine(left, right, "speakers_bookmarked", ["num_checkins", "num_bookmarks"])
    assert sorted((r.num_bookmarks, r.speakers_bookmarked) for r in got.collect()) == [(1, 2), (5, 2)]


def test_chain_and_stamp(frame):
    empty = frame([], EXTRACT.format("num_views"))
    spent = empty.withColumn("timespent", F.lit(1.5))
    extracts = {
        "bookmarks": frame([row(2, 1)], EXTRACT.format("num_bookmarks")),
        "checkins": frame([row(2, 3)], EXTRACT.format("num_checkins")).withColumnRenamed("application_id", "applicationid"),
        "speaker_bookmarks": frame([], EXTRACT.format("num_bookmarks")),
        "speaker_views": empty,
        "speaker_dwell": spent,
        "views": frame([row(2, 1), row(2, 2, item=9)], EXTRACT.format("num_views")),
        "session_dwell": frame([row(2, 1)], EXTRACT.format("x")).withColumn("timespent", F.lit(2.5)),
    }
    out = combine_stages(extracts, datetime(2024, 1, 4), 72)
    got = sorted((r.itemid, r.num_checkins, r.num_bookmarks, r.sessions_viewed, r.sessions_timespent) for r in out.collect())
    assert got == [("1", 3, 1, None, 2.5), ("9", None, None, 2, None)]
    stamped = stamp_actions(out, 7, datetime(2024, 1, 4)).collect()
    assert {r.batchid for r in stamped} == {7}


def test_row_order_and_partitions_do_not_matter(frame):
    left, right = [row(d, d) for d in range(2, 12)], [row(d, 2 * d) for d in range(3, 9)]
    once = first_stage(frame, left, right)
    again = combine(
        side(frame, left[::-1], "num_bookmarks").repartition(7),
        side(frame, right[::-1], "num_checkins").repartition(3),
        "num_checkins",
        [],
        "full",
        ("num_bookmarks",),
    )
    assert pick(once) == pick(again)


def test_look_back_cuts_at_the_hour_and_not_at_the_day(frame):
    rows = [("a", "u", f"2024-01-01 {hour:02d}:00:00", "t", 1, item, 1, "name") for hour, item in ((11, 1), (13, 2))]
    df = frame(rows, EXTRACT.format("num_bookmarks"))
    kept = touchpoint(df, "num_bookmarks", "num_bookmarks", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    assert [r.itemid for r in kept.collect()] == ["2"]
