"""Topic runs: scores per topic, and validation of generated topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zealmark.operators.leads import topic_leads
from zealmark.operators.topics import semantic_actions, semantic_gate, topic_scores, topic_validation
from zealmark.schemas import TABLES
from zealmark.sources import state, tables
from zealmark.sources.versions import VersionedTable


def run_topic_scores(
    spark: SparkSession,
    actions: DataFrame,
    tags: DataFrame,
    details: DataFrame,
    applications: DataFrame,
    root: str,
    batch: int | None = None,
) -> None:
    """Tag, gate, score and enrich one batch of ``actions`` (the newest by default); each table's batch is replaced in one step.

    A batch of which nothing passes the gate leaves no rows in any of the tables.
    """
    batch = state.high_water(actions, "batchid") if batch is None else batch
    if batch is None:
        return
    gated = semantic_gate(semantic_actions(actions.filter(F.col("batchid") == batch), tags))
    _table(spark, root, "actions_semantic").replace_batches(gated, [batch])

    def stored(name: str) -> DataFrame:
        return topic_table(spark, root, name).filter(F.col("batchid") == batch)

    if stored("actions_semantic").isEmpty():
        for name in ("scores_semantic", "leads_semantic"):
            _table(spark, root, name).drop_batches([batch])
        return
    _table(spark, root, "scores_semantic").replace_batches(topic_scores(stored("actions_semantic")), [batch])
    people = topic_leads(stored("scores_semantic"), details, applications)
    _table(spark, root, "leads_semantic").replace_batches(people, [batch])


def _table(spark: SparkSession, root: str, name: str) -> VersionedTable:
    return VersionedTable(spark, f"{root.rstrip('/')}/{name}", ["batchid"])


def topic_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table of the topic runs as written so far; empty before the first run."""
    return _table(spark, root, name).read(TABLES[name])


def run_topic_validation(manual: DataFrame, generated: DataFrame, path: str) -> None:
    """Replace the validation table as a whole."""
    tables.overwrite(topic_validation(manual, generated), path, "topic_validation")
