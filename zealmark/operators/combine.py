"""Seven touchpoints side by side: six joins that each add one metric."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.functions.columns import hours_before
from zealmark.operators.hot_keys import count_hot, split_outer_join
from zealmark.schemas import DWELL_METRICS, METRICS, enforce_schema
from zealmark.session import stage

KEYS = ("application_id", "global_user_id", "created", "session_track", "itemid", "filterid", "session_name")
# how a person, item and track are matched: upper and lower case are the same
MATCH = ("_app", "_user", "itemid", "filterid", "_track")


class Stage(NamedTuple):
    metric: str
    source: str  # name of the extract
    value: str  # its measure
    how: str
    min_value: int | None = None


STAGES = (
    Stage("num_checkins", "checkins", "num_checkins", "full"),
    Stage("speakers_bookmarked", "speaker_bookmarks", "num_bookmarks", "full"),
    Stage("speakers_viewed", "speaker_views", "num_views", "full"),
    Stage("speakers_viewed_timespent", "speaker_dwell", "timespent", "full"),
    Stage("sessions_viewed", "views", "num_views", "full", 2),
    Stage("sessions_timespent", "session_dwell", "timespent", "left"),
)


def touchpoint(df: DataFrame, value: str, metric: str, cut: Column, min_value: int | None = None) -> DataFrame:
    """Recent rows of an extract in the shape of the combine: seven keys and one metric."""
    app = "applicationid" if "applicationid" in df.columns else "application_id"
    df = df.filter(F.col("created") > cut)
    if min_value is not None and min_value > 1:
        df = df.filter(F.col(value) >= min_value)
    return df.selectExpr(
        f"{app} as application_id",
        "global_user_id",
        "created",
        "session_track",
        "cast(itemid as string) as itemid",
        "cast(filterid as string) as filterid",
        "session_name",
        f"{value} as {metric}",
    )


def _matchable(df: DataFrame) -> DataFrame:
    if "_app" in df.columns:
        return df
    return df.selectExpr(
        "*", "lower(application_id) as _app", "lower(global_user_id) as _user", "lower(session_track) as _track"
    )


def total(metric: str) -> Column:
    # time adds up to whole microseconds again, whatever the order of addition was
    return F.expr(f"round(sum({metric}), 6)" if metric in DWELL_METRICS else f"sum({metric})").alias(metric)


def combine(
    left: DataFrame,
    right: DataFrame,
    metric: str,
    carried: Sequence[str],
    how: str = "full",
    summed: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Join ``right``'s metric to ``left`` by person, item and track.

    * A missing track or filter never matches, so such rows stay apart.
    * ``created`` is not matched: each pair of rows of one key counts, and its
      row carries the earlier time. Sums over several rows of one key are
      therefore larger than the plain totals, and a key with n and m rows gives n times m.
      ``combine_summed`` adds up the same touchpoints without pairs.
    * ``carried`` metrics of the left side are part of the row's identity; only
      the new metric (and ``summed``) is added up.

    The result keeps lowercase match columns and is laid out by them, so a chain
    of these joins shuffles each side once per stage.

    With ``hot_rows`` keys of more rows than that on a side are split over many
    tasks (``hot_keys``); both sides are then read more than once and should be stored.
    """
    either = [f"coalesce(a.{k}, b.{k}) as {k}" for k in (*KEYS[1:], "_app", "_user", "_track") if k != "created"]
    sides = _matchable(left), _matchable(right)
    hot = None if hot_rows is None else count_hot(*sides, MATCH, hot_rows)
    crowded = hot is not None and not hot.isEmpty()
    if crowded:
        pairs = split_outer_join(*sides, MATCH, how, hot_rows, hot)
    else:
        pairs = sides[0].alias("a").join(sides[1].alias("b"), F.expr(" and ".join(f"a.{k} = b.{k}" for k in MATCH)), how)
    joined = pairs.selectExpr(
        "coalesce(a.application_id, lower(b.application_id)) as application_id",
        *either,
        "least(a.created, b.created) as created",
        *[f"a.{c}" for c in (*carried, *summed)],
        f"b.{metric}",
    )
    # grouping by a superset of the match columns needs no further shuffle, nor does the next stage's left side;
    # the rows of a hot key are added up where they are and then dealt by all columns of their group
    laid_out = joined if crowded else joined.repartition(*MATCH)
    return laid_out.groupBy(*KEYS, "_app", "_user", "_track", *carried).agg(*[total(c) for c in (*summed, metric)])


def combine_stages(
    extracts: dict[str, DataFrame],
    as_of: str | datetime,
    lookback_hours: float = 72,
    upto: int = 6,
    min_views: int = 2,
    last_join: str = "left",
    hot_rows: int | None = None,
) -> DataFrame:
    """Stages 1..``upto`` of the combine over the rows of the last ``lookback_hours``.

    ``extracts`` holds bookmarks, checkins, speaker_bookmarks, speaker_views,
    speaker_dwell, views and session_dwell. The time filter sits before each
    join, because it cannot be pushed through an outer join.  With ``hot_rows``
    each stage is stored and the next one splits the keys that have grown hot.
    """
    cut = hours_before(as_of, lookback_hours)
    out = touchpoint(extracts["bookmarks"], "num_bookmarks", "num_bookmarks", cut)
    carried: list[str] = []
    for place, step in enumerate(STAGES[:upto]):
        least = min_views if step.metric == "sessions_viewed" else None
        right = touchpoint(extracts[step.source], step.value, step.metric, cut, least)
        how = last_join if place == len(STAGES) - 1 else step.how
        summed = ("num_bookmarks",) if place == 0 else ()
        out = combine(out, right, step.metric, carried, how, summed, hot_rows)
        if hot_rows is not None and place + 1 < upto:
            out = stage(out, f"combine-{place + 1}")
        carried = list(METRICS[: place + 2])
    return enforce_schema(out, f"combine_{upto}")


def combine_summed(
    extracts: dict[str, DataFrame], as_of: str | datetime, lookback_hours: float = 72, min_views: int = 2, last_join: str = "left"
) -> DataFrame:
    """All recent touchpoints of one person, item and track in one row: plain totals, in time linear in the extracts.

    The extracts are stacked and grouped once, partly before the only shuffle.
    ``created`` is the earliest time. Rows without track or filter match no
    other extract, so they are added up within their own one. A group of
    session dwell alone drops out unless ``last_join="full"``.
    """
    cut = hours_before(as_of, lookback_hours)
    parts = [touchpoint(extracts["bookmarks"], "num_bookmarks", "num_bookmarks", cut).withColumn("_part", F.lit("num_bookmarks"))]
    for step in STAGES:
        least = min_views if step.metric == "sessions_viewed" else None
        part = touchpoint(extracts[step.source], step.value, step.metric, cut, least)
        parts.append(part.withColumn("_part", F.lit(step.metric)))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    unmatched = F.col("session_track").isNull() | F.col("filterid").isNull() | F.col("itemid").isNull()
    alone = F.when(unmatched, F.col("_part"))
    out = (
        _matchable(stacked)
        .withColumn("_alone", alone)
        .groupBy(*MATCH, "_alone")
        .agg(
            F.min("global_user_id").alias("global_user_id"),
            F.min("created").alias("created"),
            F.min("session_track").alias("session_track"),
            F.min("session_name").alias("session_name"),
            *[total(m) for m in METRICS],
            F.bool_or(F.col("_part") != STAGES[-1].metric).alias("_more"),
        )
        .withColumn("application_id", F.col("_app"))
    )
    return enforce_schema(out if last_join == "full" else out.filter("_more"), f"combine_{len(STAGES)}")


def stamp_actions(combined: DataFrame, batchid: int, as_of: str | datetime, lookback_hours: float = 72) -> DataFrame:
    """The run's action set: recent combined rows with the run's batch id."""
    recent = combined.filter(F.col("created") > hours_before(as_of, lookback_hours))
    return enforce_schema(recent.withColumn("batchid", F.lit(batchid).cast("bigint")), "actions_stag")
