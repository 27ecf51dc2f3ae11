"""Touchpoint extracts: bookmarks, views and check-ins per person and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.functions.columns import item_id, moment
from zealmark.operators.catalog import SESSION, SESSION_COLUMNS, Content, Dims, items_of
from zealmark.operators.hot_keys import split_outer_join
from zealmark.schemas import enforce_schema
from zealmark.session import stage

PERSON = ("application_id", "global_user_id", "created")


def item_counts(facts: DataFrame, identifier: str) -> DataFrame:
    """Events per person, time, batch and item; the only shuffle of the fact table."""
    return (
        facts.filter(F.col("identifier") == identifier)
        .select(
            "application_id",
            "global_user_id",
            "created",
            F.col("batch_id").alias("batchid"),
            item_id().alias("itemid"),
        )
        .filter("itemid is not null")
        .groupBy(*PERSON, "batchid", "itemid")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def meet(per_item: DataFrame, content: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """Rows of items with the content rows of ``key``.

    With ``hot_rows`` the items are counted first (``per_item`` is then read twice and should be stored); the rows of an item
    above it are dealt over many tasks, and only such items' content is copied to each of them.
    """
    if hot_rows is None:
        return per_item.join(content, key)
    more = [F.col(f"b.`{c}`").alias(c) for c in content.columns if c != key]
    return split_outer_join(per_item, content, [key], "inner", hot_rows).select("a.*", *more)


def credit(per_item: DataFrame, content: DataFrame, key: str, value: str, metric: str, hot_rows: int | None = None) -> DataFrame:
    """Add up ``value`` per person, batch and session, over the sessions each item counts for.

    Items of a session are already laid out by their person or by the item, both
    part of the grouping, so crediting sessions needs no further shuffle.
    """
    return (
        meet(per_item.withColumnRenamed("itemid", key), content, key, hot_rows)
        .groupBy(*PERSON, "batchid", *SESSION_COLUMNS)
        .agg(F.expr(value).alias(metric))
        .withColumn("application_id", F.lower("application_id"))
    )


def bookmarked_sessions(counts: DataFrame, content: Content) -> DataFrame:
    enabled = content.sessions.filter("item_off = 0")
    return enforce_schema(credit(counts, enabled, "itemid", "sum(n * fanout)", "num_bookmarks", content.hot_rows), "sessions_bookmarked")


def viewed_sessions(counts: DataFrame, content: Content) -> DataFrame:
    enabled = content.sessions.filter("item_off = 0")
    return enforce_schema(credit(counts, enabled, "itemid", "sum(n * fanout)", "num_views", content.hot_rows), "sessions_viewed")


def bookmarked_speakers(counts: DataFrame, content: Content) -> DataFrame:
    credited = credit(counts, content.speakers, "speakerid", "sum(n * fanout)", "num_bookmarks", content.hot_rows)
    return enforce_schema(credited, "sessions_speakers_bookmarked")


def bookmarks(actions: DataFrame, content: Content) -> DataFrame:
    """Bookmarks of sessions."""
    return bookmarked_sessions(item_counts(actions, "bookmarkButton"), content)


def views(facts: DataFrame, content: Content) -> DataFrame:
    """Views of sessions."""
    return viewed_sessions(item_counts(facts, "item"), content)


def speaker_bookmarks(actions: DataFrame, content: Content) -> DataFrame:
    """Bookmarks of speakers, credited to every session of the speaker."""
    return bookmarked_speakers(item_counts(actions, "bookmarkButton"), content)


def _rows_per(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias("user_key")).agg(F.count(F.lit(1)).alias(name))


def viewed_speakers(
    counts: DataFrame, content: Content, users: DataFrame, details: DataFrame, user_match: str = "inner"
) -> DataFrame:
    accounts = _rows_per(users, F.lower("globaluserid"), "k")
    profiles = _rows_per(details, F.lower("globaluserid"), "d")
    known = accounts.join(profiles, "user_key").withColumn(
        "weight", F.lit(1) if user_match == "semi" else F.expr("k * d")
    )
    known_counts = counts.withColumn("user_key", F.lower("global_user_id")).join(
        known.select("user_key", "weight"), "user_key"
    )
    if content.hot_rows is not None:
        known_counts = stage(known_counts, "known-views")
    credited = credit(known_counts, content.speakers, "speakerid", "sum(n * weight * fanout)", "num_views", content.hot_rows)
    return enforce_schema(credited, "sessions_speakers_viewed")


def speaker_views(
    facts: DataFrame,
    content: Content,
    users: DataFrame,
    details: DataFrame,
    user_match: str = "inner",
) -> DataFrame:
    """Views of speakers by known users, credited to every session of the speaker.

    A user with k account rows and d detail rows counts k*d times, which is the
    meaning of the two inner joins; the rows are counted per user first, so the
    views are joined with one row per user. ``user_match="semi"`` counts each
    view once.
    """
    return viewed_speakers(item_counts(facts, "item"), content, users, details, user_match)


def checkins(
    checkin: DataFrame,
    notes: DataFrame,
    content: Content,
    users: DataFrame,
) -> DataFrame:
    """Check-in notes per person and session.

    Notes are counted, not check-ins, and a session drops out when its *topic*
    is disabled; the item's own flag is not looked at.
    """
    noted = notes.groupBy("checkinid").agg(F.count(F.lit(1)).alias("notes"))
    per_person = (
        checkin.join(noted, "checkinid")
        .groupBy("applicationid", "userid", "created", "itemid")
        .agg(F.sum("notes").alias("n"))
    )
    if content.hot_rows is not None:
        per_person = stage(per_person, "checked-in")
    accounts = users.groupBy("userid", F.col("globaluserid").alias("global_user_id")).agg(
        F.count(F.lit(1)).alias("accounts")
    )
    credited = (
        meet(per_person, content.sessions.filter("topic_off = 0"), "itemid", content.hot_rows)
        .join(accounts, "userid")
        .groupBy("applicationid", "global_user_id", "created", *SESSION_COLUMNS)
        .agg(F.expr("sum(n * fanout * accounts)").alias("num_checkins"))
        .withColumn("applicationid", F.lower("applicationid"))
    )
    return enforce_schema(credited, "sessions_checkins_status")


def rejected_item_ids(facts: DataFrame) -> DataFrame:
    """How many facts carry an item id that is not a number (they match no item)."""
    raw = F.get_json_object("metadata", "$.ItemId")
    return facts.agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(raw.isNotNull() & item_id().isNull()).alias("rejected"),
    )


def audience_coverage(
    facts: DataFrame,
    dims: Dims,
    users: DataFrame,
    applications: DataFrame,
    implementation: DataFrame,
    ends_from: str,
    ends_to: str,
) -> DataFrame:
    """Viewing users and views of sessions, per implemented application that ends between two dates."""
    items = items_of(dims, SESSION).filter("item_off = 0").groupBy("itemid").agg(F.count(F.lit(1)).alias("fanout"))
    viewed = (
        facts.filter(F.col("identifier") == "item")
        .select("application_id", F.lower("global_user_id").alias("user_key"), item_id().alias("itemid"))
        .groupBy("application_id", "user_key", "itemid")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(items, "itemid")
        .groupBy("application_id", "user_key")
        .agg(F.sum(F.col("n") * F.col("fanout")).alias("n"))
    )
    accounts = users.groupBy(F.lower("globaluserid").alias("user_key"), "userid").agg(
        F.count(F.lit(1)).alias("accounts")
    )
    ending = (
        applications.filter(F.col("enddate").between(moment(ends_from), moment(ends_to)))
        .groupBy(F.lower("applicationid").alias("app_key"))
        .agg(F.count(F.lit(1)).alias("apps"))
    )
    implemented = implementation.groupBy(F.lower("applicationid").alias("app_key")).agg(
        F.count(F.lit(1)).alias("implementations")
    )
    # one row per application and user id before the count, so no distinct set is ever held in one task
    return (
        viewed.withColumn("app_key", F.lower("application_id"))
        .join(ending.join(implemented, "app_key"), "app_key")
        .join(accounts, "user_key")
        .groupBy("application_id", "userid")
        .agg(F.sum(F.col("n") * F.col("accounts") * F.col("apps") * F.col("implementations")).alias("n"))
        .groupBy("application_id")
        .agg(F.count("userid").alias("num_users_sessions_viewed"), F.sum("n").alias("num_views_sessions"))
    )
