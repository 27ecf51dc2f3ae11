"""Content dimension: which sessions an item event counts for, and on which tracks.

The dimension tables are joined with each other and grouped, with ``fanout``
counting the rows (also copies) that each combination stands for. A fact is
grouped by item *before* it meets the content, so it is shuffled once, narrow
and partially aggregated, and a hot item is one row per person rather than a hot
join key. Joins carry no broadcast hint: Spark broadcasts a side whose size it
has checked, and otherwise joins by sort-merge with skew splitting.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION, SPEAKER = 2, 4  # list types
SESSION_COLUMNS = ("itemid", "session_name", "filterid", "session_track")


class Dims(NamedTuple):
    item: DataFrame
    topic: DataFrame
    item_filter: DataFrame
    filters: DataFrame
    item_mapping: DataFrame


class Content(NamedTuple):
    """``sessions``: every session and track with the item's and the topic's disabled flag.
    ``speakers``: enabled speakers with the enabled sessions linked to them.
    ``hot_rows``: items with more event rows than this are dealt over many tasks when they
    meet the content (None: left to Spark, which does so for what is too large to broadcast as far as its partitions show)."""

    sessions: DataFrame
    speakers: DataFrame
    hot_rows: int | None = None


def items_of(dims: Dims, listtype: int) -> DataFrame:
    """Items of one list type: (itemid, session_name, item_off, topic_off)."""
    topic = dims.topic.filter(F.col("listtypeid") == listtype).selectExpr("topicid", "isdisabled as topic_off")
    item = dims.item.selectExpr("itemid", "name as session_name", "parenttopicid as topicid", "isdisabled as item_off")
    return item.join(topic, "topicid").drop("topicid")


def content(dims: Dims, track_join: str = "left") -> Content:
    """Build the content; ``track_join="inner"`` leaves out sessions without a track.

    A session with several tracks has several rows, so each track gets full
    credit. ``filterid`` is the id the session was mapped to, ``trackid`` the id
    of the track itself, NULL where the mapping points to none.
    """
    mapping = dims.item_filter.select("itemid", "filterid")
    tracks = dims.filters.selectExpr("filterid as trackid", "name as session_track")
    sessions = (
        items_of(dims, SESSION)
        .join(mapping, "itemid", track_join)
        .join(tracks, F.expr("filterid = trackid"), track_join)
        .groupBy(*SESSION_COLUMNS, "trackid", "item_off", "topic_off")
        .agg(F.count(F.lit(1)).alias("fanout"))
    )
    enabled_speakers = items_of(dims, SPEAKER).filter("item_off = 0").selectExpr("itemid as speakerid")
    links = dims.item_mapping.selectExpr("targetitemid as speakerid", "sourceitemid as itemid")
    speakers = (
        enabled_speakers.join(links, "speakerid")
        .join(sessions.filter("item_off = 0"), "itemid")
        .groupBy("speakerid", *SESSION_COLUMNS)
        .agg(F.sum("fanout").alias("fanout"))
    )
    return Content(sessions, speakers)
