"""Ranges, quantiles, grades and titles."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from zealmark.functions.columns import title_bucket
from zealmark.operators.health import event_grade, headline_percent
from zealmark.operators.order_stats import quantiles, values_at
from zealmark.operators.scoring import grade, range_score, zero_missing


def scores(frame, rows, **options):
    df = range_score(frame(rows, "x double, y double"), ["x", "y"], "s", **options)
    return [r.s for r in df.collect()]


def test_score_is_scaled_by_the_range_and_not_shifted(frame):
    assert sorted(scores(frame, [(1.0, 10.0), (3.0, 20.0)])) == [0.5 + 1.0, 1.5 + 2.0]


def test_all_zero_metric_makes_the_score_undefined(frame):
    rows = [(0.0, 1.0), (0.0, 2.0)]
    assert scores(frame, rows) == [None, None]
    assert scores(frame, rows, undefined="zero") == [0.0, 0.0]
    assert scores(frame, rows, zero_range="ignore") == [1.0, 2.0]
    with pytest.raises(ValueError, match="undefined"):
        scores(frame, rows, undefined="error")


def test_constant_metric_makes_the_score_infinite(frame):
    for undefined in ("null", "zero", "error"):
        assert scores(frame, [(5.0, 1.0), (5.0, 2.0)], undefined=undefined) == [math.inf, math.inf]
    assert scores(frame, [(5.0, 1.0)]) == [math.inf]


def test_infinite_and_zero_scores_are_all_c(frame):
    for s in (math.inf, 0.0):
        graded = grade(frame([(s,), (s,)], "s double"), "s", (0.2, 0.8))
        assert {r.grade_score for r in graded.collect()} == {"C"}


def test_grades_at_the_quantiles(frame):
    df = frame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "s double")
    assert quantiles(df, "s", [0.2, 0.8]) == pytest.approx([1.6, 5.8])
    got = {r.s: r.grade_score for r in grade(df, "s", (0.2, 0.8)).collect()}
    assert got == {1.0: "C", 2.0: "B", 3.0: "B", 10.0: "A", None: None}


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed", "tiny"])
def test_counted_quantiles_equal_sorted_ones(frame, kind):
    rng = random.Random(kind)
    values = {
        "spread": [rng.random() for _ in range(2000)],
        "ties": [float(rng.choice([0, 0, 0, 1, 2])) for _ in range(2000)],
        "skewed": [10 ** rng.uniform(-12, 12) for _ in range(2000)],
        "tiny": [3.0],
    }[kind]
    df = frame([(v,) for v in values], "s double")
    probs = [0.0, 0.2, 0.33, 0.66, 0.8, 1.0]
    exact = df.agg(F.percentile("s", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert quantiles(df, "s", probs) == list(exact)
    ordered = sorted(values)
    ranks = [0, len(values) // 3, len(values) - 1]
    assert values_at(df, "s", ranks) == {r: ordered[r] for r in ranks}


def test_ranks_of_weighted_rows(frame):
    df = frame([(1.0, 3), (2.0, 1), (5.0, 4)], "s double, n bigint")
    assert values_at(df, "s", [0, 2, 3, 4, 7], weight="n") == {0: 1.0, 2: 1.0, 3: 2.0, 4: 5.0, 7: 5.0}


def test_missing_becomes_zero_also_in_text(frame):
    row = zero_missing(frame([(None, None)], "track string, n bigint")).first()
    assert tuple(row) == ("0", 0)


@pytest.mark.parametrize(
    ("title", "bucket"),
    [
        ("Chief Engineer", "Engineer"),
        ("AVP", "Vice President"),
        ("vp sales", "Individual Contributor"),
        ("Vice president", "Vice President"),
        ("ceo", "Individual Contributor"),
        ("CTO", "C-Level exec"),
        ("chief of staff", "C-Level exec"),
        ("Director", "Director"),
        ("VP, Specialist", "Individual Contributor"),
        ("Account MANAGER and Director", "Manager"),
        (None, "Individual Contributor"),
    ],
)
def test_titles(frame, title, bucket):
    assert frame([(title, 1)], "t string, n int").select(title_bucket("t")).first()[0] == bucket


HEALTH = "id string, users bigint, score double, enddate timestamp_ntz"


def test_event_grades(frame):
    def at(day):
        return f"2024-01-{day:02d} 00:00:00"

    # scores 1, 1.2, 1.3, 1.5, 2, 8, 8.5, 9: the lower cut is 1.362, the upper one 5.72
    rows = [
        ("weak today", 99, 1.0, at(10)),
        ("weak in six days", 99, 1.2, at(16)),
        ("weak in seven days", 99, 1.3, at(17)),
        ("strong, small", 50, 9.0, at(11)),
        ("strong", 51, 8.0, at(11)),
        ("strong as well", 51, 8.5, at(11)),
        ("middling", 51, 2.0, at(11)),
        ("past", 51, 1.5, at(9)),
        ("undefined, closing", 51, None, at(12)),
        ("undefined, small", 50, None, at(20)),
        ("undefined, small, closing", 50, None, at(12)),
    ]
    got = {r.id: r.grade_score for r in event_grade(frame(rows, HEALTH), "2024-01-10 00:00:00").collect()}
    assert got == {
        "weak today": "C",
        "weak in six days": "C",
        "weak in seven days": "B",
        "strong, small": "B",
        "strong": "A",
        "strong as well": "A",
        "middling": "B",
        "past": "B",
        "undefined, closing": None,
        "undefined, small": "B",
        "undefined, small, closing": None,
    }


def test_headline(frame):
    schema = "grade_score string, enddate timestamp_ntz"
    rows = [
        ("C", "2024-01-10 00:00:00"),
        ("A", "2024-01-15 00:00:00"),
        (None, "2024-01-11 00:00:00"),
        ("C", "2024-01-15 00:00:01"),
        ("C", "2024-01-09 23:59:59"),
    ]
    assert headline_percent(frame(rows, schema), "2024-01-10 00:00:00").first()[0] == 66.7
    assert headline_percent(frame(rows, schema).filter(F.lit(False)), "2024-01-10 00:00:00").first()[0] is None
