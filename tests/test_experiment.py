"""Cohorts: draws, splits, ties and shares."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from zealmark.operators import experiment as ex
from zealmark.operators.outreach import merge_vars, percent_text
from zealmark.operators.topics import correlation_label, histogram, linear_fit, topic_sides, topic_validation

TOP = "userid bigint, applicationid string, topic_1 string"


def test_top_topic_prefers_grade_then_score_then_name(frame, collected):
    rows = [
        (1, "a", "zz", "A", 1.0),
        (1, "a", "yy", "B", 9.0),
        (2, "a", "q", "B", 2.0),
        (2, "a", "p", "B", 3.0),
        (3, "a", "n", "C", 1.0),
        (3, "a", "m", "C", 1.0),
    ]
    df = frame(rows, "userid bigint, applicationid string, topic string, grade_score string, score double")
    assert collected(ex.top_topic(df)) == [(1, "a", "zz"), (2, "a", "p"), (3, "a", "m")]


def test_contrast_topic_is_another_one_of_the_application(frame):
    rows = [(i, "a", f"t{i % 3}") for i in range(60)] + [(i, "lonely", "only") for i in range(5)]
    got = ex.contrast_topic(frame(rows, TOP)).collect()
    assert len(got) == 60 and {r.applicationid for r in got} == {"a"}
    assert all(r.topic_1 != r.topic_2 and r.topic_2 in {"t0", "t1", "t2"} for r in got)


def test_contrast_topic_follows_the_shares_of_the_others(frame):
    rows = [(i, "a", "x" if i < 600 else "y" if i < 900 else "z") for i in range(1000)]
    shares = Counter(r.topic_2 for r in ex.contrast_topic(frame(rows, TOP)).collect() if r.topic_1 == "x")
    assert sum(shares.values()) == 600 and 0.68 < shares["y"] / 600 < 0.82  # 300 of 400


def test_draws_do_not_depend_on_order_or_partitions(frame, collected):
    rows = [(i, "a", f"t{i % 7}") for i in range(100)]
    assert collected(ex.contrast_topic(frame(rows, TOP))) == collected(ex.contrast_topic(frame(rows[::-1], TOP).repartition(9)))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_split_is_exact(frame, n):
    pool = frame([(i, "a") for i in range(n)], "userid bigint, applicationid string")
    halves = Counter(r.half for r in ex.repeat_copies(ex.split_exact(pool)).collect())
    assert (halves[1], halves[2]) == (n // 2, n - n // 2)


def test_split_of_copies(frame):
    rows = [(1, "a")] * 9001 + [(i, "a") for i in range(2, 1002)]
    pool = frame(rows, "userid bigint, applicationid string")
    got = ex.repeat_copies(ex.split_exact(pool)).groupBy("half").count().collect()
    assert {r["half"]: r["count"] for r in got} == {1: 5000, 2: 5001}


def test_high_low_ties(frame, collected):
    rows = [(1, "a", "p"), (2, "a", "q"), (3, "b", "x"), (4, "b", "x"), (5, "b", "y")]
    assert collected(ex.high_low(frame(rows, TOP)).select("applicationid", "high", "low")) == [("a", "q", "p"), ("b", "x", "y")]


def test_cohorts_share_no_person_and_keep_everyone(frame, spark):
    top = frame([(i, "a", f"t{i % 3}") for i in range(30)], TOP)
    users = frame([(i, "A") for i in range(101)] + [(500, "other")], "userid bigint, applicationid string")
    got = ex.cohorts(top, users, ["a"]).collect()
    kinds = Counter(r.identification_type for r in got)
    assert kinds == {"identified": 30, "random": 35, "random_high_low": 36}
    assert len({r.userid for r in got}) == 101
    pairs = {(r.topic_1, r.topic_2) for r in got if r.identification_type == "identified"}
    assert {(r.topic_1, r.topic_2) for r in got if r.identification_type == "random"} <= pairs
    apps = frame([("A", "Event")], "applicationid string, name string")
    labelled = ex.cohorts(top, users, ["a"], labels=("One", "Two", "Three"))
    named = ex.cohorts_named(labelled, apps)
    assert {r.identification_type for r in named.collect()} == {"one", "two", "three"}
    assert ex.cohort_slice(named, userid=3).count() == 1
    line = json.loads(ex.chat_payload(ex.cohort_slice(named, userid=3, applicationid="A")).first()[0])
    assert line["event_name"] == "Event" and line["userid"] == 3


def test_base_counts_overlapping_batches_unless_latest(frame):
    metrics = ", ".join(f"{m} double" if m.endswith("timespent") else f"{m} bigint" for m in ex.METRICS)
    schema = f"application_id string, global_user_id string, created timestamp_ntz, itemid string, batchid bigint, {metrics}"
    values = (1, 1, 1, 1, 1.0, 1, 1.0)
    actions = frame([("A", "U1", "2024-01-01 00:00:00", "1", b, *values) for b in (1, 2)], schema)
    topics = frame([(1, "x")], "itemid bigint, topic string")
    users = frame([(7, "u1", "a")], "userid bigint, globaluserid string, applicationid string")
    assert [r.num_checkins for r in ex.topic_sums(ex.experiment_base(actions, topics, users)).collect()] == [2]
    latest = ex.experiment_base(actions, topics, users, ["a"], batches="latest")
    assert [r.num_checkins for r in ex.topic_sums(latest).collect()] == [1]
    assert ex.experiment_base(actions, topics, users, ["b"]).count() == 0


def test_validation_counts(frame, collected):
    manual = frame([(1, "A"), (1, "a"), (1, "B"), (2, "x"), (3, "m")], "itemid bigint, topic string")
    generated = frame([(1, "a"), (1, "c"), (1, "d"), (2, "y"), (4, "m")], "itemid bigint, topic string")
    got = collected(topic_validation(manual, generated))
    assert got == [(1, 2, 3, 1, 1, 1 / 3, 0.5), (2, 1, 1, 0, 1, 0.0, 0.0)]
    assert topic_sides(manual, generated).count() == 6


def test_label_histogram_and_fit(frame, collected):
    df = frame([(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)], "x double, y double")
    assert correlation_label(df, "x", "y").first()[0] == "r =  1"
    bins = frame([(0.0,), (0.05,), (0.051,), (0.15,), (1.0,), (None,)], "v double")
    assert collected(histogram(bins, ["v"]).select("bin", "frequency")) == [(0, 2), (1, 2), (10, 1)]
    fit = linear_fit(frame([(1.0, 1.0), (2.0, 2.0), (3.0, 2.0), (4.0, 4.0)], "x double, y double"), "x", "y").first()
    assert fit["slope"] == pytest.approx(0.9) and fit["residual_se"] == pytest.approx((0.7 / 2) ** 0.5)


def test_merge_variables(frame):
    df = frame([("Ann", 83.3)], "name string, p double")
    tags = F.create_map(F.lit("PERCENT"), percent_text(F.col("p")), F.lit("USER_NAME"), F.col("name"))
    got = [(v["name"], v["content"]) for v in df.select(merge_vars(tags).alias("v")).first()["v"]]
    assert got == [("PERCENT", "83.3%"), ("USER_NAME", "Ann")]


def test_intervals_lie_end_to_end(frame):
    rows = [("a", f"t{i}", i % 5 + 1) for i in range(3000)] + [("b", "x", 2)]
    laid = ex._laid_out(frame(rows, "applicationid string, topic_1 string, n bigint"), "applicationid", ["topic_1"], "n")
    spans = sorted((r.applicationid, r.start, r.stop, r.n) for r in laid.collect())
    assert all(stop - start == n for _, start, stop, n in spans)
    ends = {"a": 0, "b": 0}
    for app, start, stop, _ in spans:
        assert start == ends[app]
        ends[app] = stop
    assert ends == {"a": 9000, "b": 2}
