"""Lead tables: scores with the person's contact data and the event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.functions.columns import title_bucket
from zealmark.schemas import enforce_schema
from zealmark.sources.state import current_batch, high_water, since


def titles(details: DataFrame) -> DataFrame:
    """Seniority bucket of every person."""
    return details.select("globaluserid", F.col("title").alias("detailed_title"), title_bucket("title").alias("title"))


def _enriched(scores: DataFrame, details: DataFrame, applications: DataFrame, user_join: str) -> DataFrame:
    people = details.select(
        F.lower("globaluserid").alias("_user"),
        F.col("title").alias("detailed_title"),
        "emailaddress",
        "firstname",
        "lastname",
        "company",
        "phone",
    )
    events = applications.select(
        F.lower("applicationid").alias("_app"), F.col("name").alias("event_name"), "startdate", "enddate"
    )
    return (
        scores.withColumns({"_user": F.lower("global_user_id"), "_app": F.lower("application_id")})
        .join(people, "_user", user_join)
        .join(events, "_app")
        .withColumn("title", title_bucket("detailed_title"))
    )


def leads(
    scores: DataFrame,
    details: DataFrame,
    applications: DataFrame,
    user_join: str = "inner",
    latest_only: bool = True,
) -> DataFrame:
    """Leads of the newest batch; people without details drop out unless ``user_join="left"``."""
    scores = current_batch(scores) if latest_only else scores
    return enforce_schema(_enriched(scores, details, applications, user_join), "leads")


def new_leads(
    scores: DataFrame, target: DataFrame, details: DataFrame, applications: DataFrame, bootstrap: bool = False
) -> DataFrame:
    """Leads of all batches newer than those in ``target``, to be appended to it."""
    fresh = since(scores, "batchid", high_water(target, "batchid"), bootstrap=bootstrap)
    return leads(fresh, details, applications, latest_only=False)


def topic_leads(
    scores: DataFrame,
    details: DataFrame,
    applications: DataFrame,
    user_join: str = "left",
    latest_only: bool = True,
) -> DataFrame:
    """Leads per topic; people without details are kept."""
    scores = current_batch(scores) if latest_only else scores
    enriched = _enriched(scores, details, applications, user_join).withColumnRenamed("V18", "z_score")
    return enforce_schema(enriched, "leads_semantic")
