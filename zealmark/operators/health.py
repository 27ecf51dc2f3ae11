"""Event health: activity ratios, score and grade per event, and the weekly headline."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zealmark.functions.columns import moment, parse_as_of, ratio
from zealmark.operators.order_stats import quantiles
from zealmark.operators.scoring import TOPIC_CUTS, range_score

# ratio column and the count it is taken of
RATIOS = (
    ("percentengaged", "usersengaged"),
    ("percentpost", "posts"),
    ("percentlikes", "likes"),
    ("percentcomments", "comments"),
    ("percentcheckins", "checkins"),
)
HEALTH_METRICS = (*(name for name, _ in RATIOS), "users")
HISTORY_MONTHS = 18
CLOSING_DAYS = 6
HEADLINE_DAYS = 5
SMALL_EVENT_USERS = 50


def event_ratios(events: DataFrame, implementation: DataFrame, as_of: str | datetime) -> DataFrame:
    """Implemented events of the last 18 months with five counts per active user; missing numbers become 0."""
    implemented = implementation.select(F.lower("applicationid").alias("_app"))
    start = moment(as_of) - F.expr(f"INTERVAL '{HISTORY_MONTHS}' MONTH")
    recent = (
        events.filter(F.col("startdate") > start)
        .withColumn("_app", F.lower("applicationid"))
        .join(implemented, "_app")
        .drop("_app")
    )
    active = F.col("usersactive")
    rated = recent.withColumns(
        {name: F.when(active == 0, F.lit(0.0)).otherwise(ratio(F.col(count), active)) for name, count in RATIOS}
    )
    numbers = [f.name for f in rated.schema if isinstance(f.dataType, T.NumericType)]
    return rated.fillna(0, subset=numbers)


def event_score(rated: DataFrame, zero_range: str = "reference") -> DataFrame:
    """Range-scaled sum of the five ratios and the number of users. Hand over a stored frame."""
    return range_score(rated, HEALTH_METRICS, "score", zero_range, undefined="null")


def event_grade(scored: DataFrame, as_of: str | datetime, cuts: tuple[float, float] = TOPIC_CUTS) -> DataFrame:
    """C for weak events that end within six days; otherwise B for small or middling events, A above.

    The grade is NULL where the score is undefined and would have decided it.
    """
    low, high = quantiles(scored, "score", list(cuts))
    today = F.lit(parse_as_of(as_of).date().isoformat()).cast("date")
    end, score = F.col("enddate"), F.col("score")
    weak = (score <= F.lit(low)) & (end <= F.date_add(today, CLOSING_DAYS)) & (end >= today)
    letter = (
        F.when(weak.isNull(), F.lit(None).cast("string"))
        .when(weak, "C")
        .when(F.col("users") <= SMALL_EVENT_USERS, "B")
        .when(score.isNull(), F.lit(None).cast("string"))
        .when(score <= F.lit(high), "B")
        .otherwise("A")
    )
    return scored.withColumn("grade_score", letter)


def headline_percent(graded: DataFrame, as_of: str | datetime) -> DataFrame:
    """Percent of the events ending within five days that are not graded C; NULL if there are none."""
    soon = graded.filter(
        (F.col("enddate") >= moment(as_of))
        & (F.col("enddate") <= moment(as_of) + F.expr(f"INTERVAL '{HEADLINE_DAYS}' DAY"))
    )
    weak = F.count_if(F.col("grade_score") == "C")
    return soon.agg(weak.alias("weak"), F.count(F.lit(1)).alias("events")).select(
        F.bround(F.try_divide((F.col("events") - F.col("weak")).cast("double"), F.col("events")) * 100, 1).alias(
            "percent"
        )
    )
