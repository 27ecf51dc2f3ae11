"""Dwell time: how long a person stayed on an item before the next event that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.functions.columns import item_id, micros_between
from zealmark.operators.catalog import Content
from zealmark.operators.ordered import CHUNK, GROUP_LIMIT, cut_hot_groups, with_next_time, with_previous
from zealmark.operators.touchpoints import credit
from zealmark.schemas import enforce_schema

VISIT = ["application_id", "global_user_id", "session_id"]
ORDER = ["created", "event_id"]
_SECONDS = "sum({0} * fanout) / 1e6D"  # whole microseconds are added, then scaled once
_FACT_COLUMNS = [*VISIT, "created", "identifier", "metadata", "batch_id", "event_id"]


def _timeline(views: DataFrame, session_events: DataFrame) -> DataFrame:
    both = views.select(_FACT_COLUMNS).unionByName(session_events.select(_FACT_COLUMNS))
    return both.withColumn("itemid", item_id()).drop("metadata")


def _with_previous(views: DataFrame, session_events: DataFrame, group_limit: int) -> tuple[DataFrame, bool]:
    timeline, cut = cut_hot_groups(_timeline(views, session_events), VISIT, "created", group_limit, "event_id")
    return with_previous(timeline, VISIT, ORDER, ["identifier", "itemid"], "previous", cut), cut


def event_lag(views: DataFrame, session_events: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Every event of a visit with the identifier and item of the event before it."""
    lagged, _ = _with_previous(views, session_events, group_limit)
    return lagged.select(
        *VISIT,
        "created",
        "event_id",
        "batch_id",
        "identifier",
        "itemid",
        F.col("previous.identifier").alias("previousidentifier"),
        F.col("previous.itemid").alias("previousitemid"),
    )


def counts_as_step():
    """Rows that end the dwell of the row before.

    Kept are: everything that is not an item view; an item view that follows no
    known item; and a view of another item after an event of another kind. A
    second item view in a row is dropped, even of a different item, so the
    first one's dwell goes on.
    """
    item, before = F.col("identifier"), F.col("previous")
    changed = (item != before["identifier"]) & (item == "item") & (F.col("itemid") != before["itemid"])
    return changed | before["itemid"].isNull() | (item != "item")


def event_dwell(views: DataFrame, session_events: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Kept events with the microseconds until the next kept event of the visit (NULL for the last).

    Two windows with a filter between them: the first looks at all rows, the
    second only at kept ones. They share one shuffle and one sort.
    """
    lagged, cut = _with_previous(views, session_events, group_limit)
    kept = lagged.filter(counts_as_step()).drop("previous")
    timed = with_next_time(kept, VISIT, ORDER, "created", "next_created", cut)
    return timed.withColumn("dwell_us", micros_between(F.col("created"), F.col("next_created"))).drop(CHUNK)


def dwell_per_item(dwell: DataFrame) -> DataFrame:
    """Microseconds per person, time, batch and item: of all kept events (``us``) and of item views (``view_us``)."""
    return (
        dwell.filter("itemid is not null")
        .groupBy(
            "application_id",
            "global_user_id",
            "created",
            F.col("batch_id").alias("batchid"),
            "itemid",
        )
        .agg(
            F.sum("dwell_us").alias("us"),
            F.expr("sum(dwell_us) filter (where identifier = 'item')").alias("view_us"),
            F.expr("count_if(identifier = 'item')").alias("views"),
        )
    )


def session_seconds(per_item: DataFrame, content: Content) -> DataFrame:
    enabled = content.sessions.filter("item_off = 0").drop("filterid").withColumnRenamed("trackid", "filterid")
    credited = credit(per_item.filter("views > 0"), enabled, "itemid", _SECONDS.format("view_us"), "timespent", content.hot_rows)
    return enforce_schema(credited.withColumnRenamed("batchid", "batch_id"), "sessions_viewed_timespent")


def speaker_seconds(per_item: DataFrame, content: Content) -> DataFrame:
    credited = credit(per_item, content.speakers, "speakerid", _SECONDS.format("us"), "timespent", content.hot_rows)
    return enforce_schema(credited, "sessions_speakers_viewed_timespent")


def session_dwell(dwell: DataFrame, content: Content) -> DataFrame:
    """Seconds spent on sessions, from item views only, by the id of the track itself."""
    return session_seconds(dwell_per_item(dwell), content)


def speaker_dwell(dwell: DataFrame, content: Content) -> DataFrame:
    """Seconds spent on speakers, credited to each of their sessions.

    Any kept event that names a speaker counts here, not only item views.
    """
    return speaker_seconds(dwell_per_item(dwell), content)
