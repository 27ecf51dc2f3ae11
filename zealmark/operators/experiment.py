"""Chat experiment: topics a person is interested in, contrast topics, and control cohorts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zealmark.functions.columns import unit_draw
from zealmark.operators.combine import total
from zealmark.operators.order_stats import values_at
from zealmark.operators.scoring import LEAD_CUTS, grade, range_score, zero_missing
from zealmark.schemas import METRICS, enforce_schema
from zealmark.session import stage
from zealmark.sources.state import current_batch
from zealmark.sources.tables import as_json_lines

# The kinds of cohort, in the order identified, popular topics, random topics
LABELS = ("identified", "random_high_low", "random")
PERSON = ["userid", "applicationid"]
SPLIT_SEED = 123
COPY_BLOCK = 4096


# --- interest ------------------------------------------------------------------------------


def in_apps(df: DataFrame, column: str, app_ids: list[str] | None) -> DataFrame:
    """Rows of the chosen applications, upper and lower case being the same; ``None`` chooses all."""
    return df if app_ids is None else df.filter(F.lower(column).isin([a.lower() for a in app_ids]))


def experiment_base(
    actions: DataFrame, topics: DataFrame, users: DataFrame, app_ids: list[str] | None = None, batches: str = "all"
) -> DataFrame:
    """Actions with the manual topics of their item and the account of their person.

    Batches overlap, so an action counts once for every batch it is in, unless
    ``batches="latest"``.
    """
    if batches == "latest":
        actions = current_batch(actions)
    accounts = users.select(F.lower("globaluserid").alias("_user"), F.lower("applicationid").alias("_app"), "userid")
    tagged = topics.select(F.col("itemid").cast("bigint").alias("_item"), "topic")
    return (
        in_apps(actions, "application_id", app_ids)
        .withColumns(
            {
                "_user": F.lower("global_user_id"),
                "_app": F.lower("application_id"),
                "_item": F.col("itemid").cast("bigint"),
            }
        )
        .join(tagged, "_item")
        .join(accounts, ["_user", "_app"])
        .select("userid", F.col("_app").alias("applicationid"), "created", "topic", "itemid", *METRICS)
    )


def topic_sums(base: DataFrame) -> DataFrame:
    """The seven metrics per person, application and topic."""
    return zero_missing(base).groupBy(*PERSON, "topic").agg(*[total(m) for m in METRICS])


def topic_interest(sums: DataFrame, zero_range: str = "reference") -> DataFrame:
    """Score and grade of every person and topic. Hand over a stored frame.

    A score that is undefined stops the run here, as no quantile can be taken.
    """
    scored = range_score(sums, METRICS, "score", zero_range, undefined="error")
    return grade(scored, "score", LEAD_CUTS)


def top_topic(interest: DataFrame) -> DataFrame:
    """Best topic per person and application: best grade, then highest score, then first name.

    A minimum over (grade, -score, topic) merges on the map side, so a person
    with very many topics needs no sort.
    """
    best = F.min(F.struct("grade_score", (-F.col("score")).alias("minus_score"), "topic"))
    return interest.groupBy(*PERSON).agg(best.alias("best")).select(*PERSON, F.col("best.topic").alias("topic_1"))


# --- weighted draws ------------------------------------------------------------------------


def _spread(intervals: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Cut each interval [start, stop) of a group into the equal cells it touches.

    A group of t intervals over 0..total gets 4t cells, hence at most 5t rows,
    and a random position meets 1.25 intervals on average. People are then
    matched by (group, cell): an equality join without pairs, which also spreads
    a group that holds most of the people over its cells.
    """
    per_group = intervals.groupBy(group).agg(
        F.max("stop").alias("total"), (F.count(F.lit(1)) * 4).alias("cells")
    )

    def cell(x):
        return F.floor(x * F.col("cells") / F.col("total"))

    return (
        intervals.join(per_group, group)
        .withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop") - 1))))
        .select(group, "cell", "start", "stop", *names)
    )


def _draw(people: DataFrame, intervals: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Attach to each row of ``people`` (with an integer ``pos``) the interval of its group that holds ``pos``."""
    sizes = intervals.groupBy(group).agg(F.max("stop").alias("total"), (F.count(F.lit(1)) * 4).alias("cells"))
    placed = people.join(sizes, group).withColumn("cell", F.floor(F.col("pos") * F.col("cells") / F.col("total")))
    return (
        placed.join(_spread(intervals, group, names), [group, "cell"])
        .filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop")))
        .drop("cell", "cells", "total", "start", "stop", "pos")
    )


def _laid_out(df: DataFrame, group: str, names: list[str], n: str) -> DataFrame:
    """Give each row an interval [start, stop) of length ``n``, end to end per group in the order of a hash.

    Running totals go over the first hash digits and then inside each of them,
    so a group with very many rows is spread over 4096 windows.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", *names))).withColumn("_bucket", F.substring("_hash", 1, 3))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(group, "_bucket")
        .agg(F.sum(n).alias("_n"))
        .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumn("stop", F.sum(n).over(inside))
        .join(offsets, [group, "_bucket"])
        .withColumn("stop", F.col("stop") + F.col("_offset"))
        .withColumn("start", F.col("stop") - F.col(n))
        .drop("_hash", "_bucket", "_offset")
    )


def contrast_topic(top: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``topic_2``: the top topic of another person of the application, among those who differ.

    Every other person with a different topic is equally likely. The people of an
    application are thought of as laid out by topic; the draw picks a place
    outside the person's own topic. People without an alternative drop out.
    """
    per_topic = top.filter("topic_1 is not null").groupBy("applicationid", "topic_1").agg(F.count(F.lit(1)).alias("n"))
    laid_out = _laid_out(per_topic, "applicationid", ["topic_1"], "n")
    totals = laid_out.groupBy("applicationid").agg(F.max("stop").alias("everyone"))
    own = laid_out.select("applicationid", "topic_1", F.col("start").alias("own_start"), F.col("n").alias("own_n"))
    people = (
        top.join(own, ["applicationid", "topic_1"])
        .join(totals, "applicationid")
        .withColumn("others", F.col("everyone") - F.col("own_n"))
        .filter(F.col("others") > 0)
        .withColumn("place", F.floor(unit_draw(f"{seed}|contrast", *PERSON) * F.col("others")))
        .withColumn(
            "pos", F.when(F.col("place") < F.col("own_start"), F.col("place")).otherwise(F.col("place") + F.col("own_n"))
        )
        .select(*PERSON, "topic_1", "pos")
    )
    others = laid_out.select("applicationid", F.col("topic_1").alias("topic_2"), "start", "stop")
    return _draw(people, others, "applicationid", ["topic_2"]).select(*PERSON, "topic_1", "topic_2")


def random_pair(people: DataFrame, pairs: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Give each distinct person one topic pair of the application's identified people, each equally likely."""
    counted = pairs.groupBy("applicationid", "topic_1", "topic_2").agg(F.count(F.lit(1)).alias("n"))
    intervals = _laid_out(counted, "applicationid", ["topic_1", "topic_2"], "n")
    totals = intervals.groupBy("applicationid").agg(F.max("stop").alias("everyone"))
    placed = (
        people.select(*PERSON, F.lower("applicationid").alias("_app"))
        .distinct()
        .join(totals.select(F.lower("applicationid").alias("_app"), "everyone"), "_app")
        .withColumn("pos", F.floor(unit_draw(f"{seed}|pair", *PERSON) * F.col("everyone")))
        .drop("everyone")
    )
    return _draw(
        placed, intervals.withColumn("_app", F.lower("applicationid")).drop("applicationid"), "_app", ["topic_1", "topic_2"]
    ).select(*PERSON, "topic_1", "topic_2")


# --- control cohorts -----------------------------------------------------------------------


def control_pool(users: DataFrame, top: DataFrame, app_ids: list[str] | None = None) -> DataFrame:
    """Accounts of the applications whose user id has no top topic in any of them."""
    return in_apps(users, "applicationid", app_ids).select(*PERSON).join(top.select("userid"), "userid", "left_anti")


def split_exact(pool: DataFrame, frac: float = 0.5, seed: int = SPLIT_SEED) -> DataFrame:
    """Random split into exactly floor(frac * n) rows (``half`` = 1) and the rest (``half`` = 2).

    Rows are taken in the order of a draw from their own values, so a retry
    splits the same way. The border draw is found by counting, not by sorting:
    no task sees more than the few rows that share it. Equal rows are split as
    copies of one row. Returns each distinct row once with its ``copies``.
    """
    keyed = stage(
        pool.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("copies")).withColumn("draw", unit_draw(f"{seed}|split", *PERSON)),
        "pool",
    )
    n = keyed.agg(F.sum("copies")).first()[0] or 0
    take = math.floor(frac * n)
    if take == 0:
        return keyed.select(*PERSON, F.lit(2).alias("half"), "copies")
    border = F.lit(values_at(keyed, "draw", [take - 1], weight="copies")[take - 1])
    below = keyed.filter(F.col("draw") < border).agg(F.sum("copies")).first()[0] or 0
    # rows that drew exactly the border value: equal draws of different people are 2**-52 rare
    before = Window.partitionBy("draw").orderBy(*PERSON).rowsBetween(Window.unboundedPreceding, -1)
    on_border = (
        keyed.filter(F.col("draw") == border)
        .withColumn("room", F.lit(take - below) - F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .withColumn("taken", F.greatest(F.lit(0), F.least("room", "copies")))
        .select(
            *PERSON,
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("half"), F.col("taken").alias("copies")),
                    F.struct(F.lit(2).alias("half"), (F.col("copies") - F.col("taken")).alias("copies")),
                )
            ).alias("part"),
        )
        .select(*PERSON, "part.half", "part.copies")
        .filter(F.col("copies") > 0)
    )
    clear = keyed.filter(F.col("draw") != border).select(
        *PERSON, F.when(F.col("draw") < border, 1).otherwise(2).alias("half"), "copies"
    )
    return clear.unionByName(on_border)


def repeat_copies(df: DataFrame) -> DataFrame:
    """One row per copy. Many copies of one row are spread over the tasks in blocks."""
    blocks = df.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"), F.lit(COPY_BLOCK))))
    spread = blocks.repartition(*PERSON, "_from")
    last = F.least(F.col("_from") + COPY_BLOCK - 1, F.col("copies"))
    return spread.withColumn("_copy", F.explode(F.sequence(F.col("_from"), last))).drop("_from", "_copy", "copies")


def high_low(top: DataFrame) -> DataFrame:
    """Most and least frequent top topic of each application (the later and the earlier name on a tie)."""
    counted = top.groupBy("applicationid", "topic_1").agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct("n", "topic_1")
    return counted.groupBy("applicationid").agg(
        F.max(pair)["topic_1"].alias("high"), F.min(pair)["topic_1"].alias("low")
    )


def cohort_high_low(people: DataFrame, topics: DataFrame) -> DataFrame:
    """Give everyone the most and the least frequent topic of their application."""
    per_app = topics.select(F.lower("applicationid").alias("_app"), "high", "low")
    return (
        people.withColumn("_app", F.lower("applicationid"))
        .join(per_app, "_app")
        .select(*PERSON, F.col("high").alias("topic_1"), F.col("low").alias("topic_2"))
    )


def cohorts(
    top: DataFrame,
    users: DataFrame,
    app_ids: list[str] | None = None,
    seed: int = SPLIT_SEED,
    labels: tuple[str, str, str] = LABELS,
) -> DataFrame:
    """The three cohorts. ``top`` (person, application, top topic) is read several times: hand over a stored frame."""
    identified = stage(contrast_topic(top, seed), "identified")
    halves = split_exact(control_pool(users, top, app_ids), 0.5, seed)
    popular = cohort_high_low(repeat_copies(halves.filter(F.col("half") == 2)), high_low(top))
    drawn = random_pair(halves.filter(F.col("half") == 1), identified, seed)
    parts = [df.withColumn("identification_type", F.lit(label)) for df, label in zip((identified, popular, drawn), labels)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cohorts_named(cohort_rows: DataFrame, applications: DataFrame) -> DataFrame:
    """Cohorts with the event's name, text columns in lowercase."""
    names = applications.select(F.lower("applicationid").alias("_app"), F.col("name").alias("event_name"))
    lowered = {c: F.lower(c) for c in ("applicationid", "topic_1", "topic_2", "identification_type")}
    named = cohort_rows.withColumn("_app", F.lower("applicationid")).join(names, "_app").withColumns(lowered)
    return enforce_schema(named, "cohorts")


def cohort_slice(cohort_rows: DataFrame, userid: int | None = None, applicationid: str | None = None) -> DataFrame:
    """Rows of one person or one application."""
    if userid is not None:
        cohort_rows = cohort_rows.filter(F.col("userid") == userid)
    if applicationid is not None:
        cohort_rows = cohort_rows.filter(F.col("applicationid") == applicationid.lower())
    return cohort_rows


def chat_payload(cohort_rows: DataFrame) -> DataFrame:
    """One JSON object per cohort row."""
    return as_json_lines(cohort_rows)


# --- responses -----------------------------------------------------------------------------


def tally(responses: DataFrame, bodies: list[str] | None = None) -> DataFrame:
    """Responses per application and text; ``bodies`` keeps the valid answers only."""
    if bodies is not None:
        responses = responses.filter(F.col("body").isin(bodies))
    return responses.groupBy("application_id", "body").agg(F.count(F.lit(1)).alias("responses"))
