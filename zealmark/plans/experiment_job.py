"""The chat experiment: from actions to cohorts and their payload."""

from __future__ import annotations

from pyspark.sql import DataFrame

from zealmark.operators import experiment as ex
from zealmark.session import stage
from zealmark.sources import tables


def interest_of(
    actions: DataFrame,
    manual_topics: DataFrame,
    users: DataFrame,
    app_ids: list[str] | None = None,
    batches: str = "all",
) -> DataFrame:
    """Graded topic interest per person."""
    base = ex.experiment_base(actions, manual_topics, users, app_ids, batches)
    return ex.topic_interest(stage(ex.topic_sums(base), "topic-sums"))


def build_cohorts(
    actions: DataFrame,
    manual_topics: DataFrame,
    users: DataFrame,
    applications: DataFrame,
    app_ids: list[str] | None = None,
    seed: int = ex.SPLIT_SEED,
    labels: tuple[str, str, str] = ex.LABELS,
    batches: str = "all",
) -> DataFrame:
    """Named cohort rows of the chosen applications."""
    top = stage(ex.top_topic(interest_of(actions, manual_topics, users, app_ids, batches)), "top-topic")
    return ex.cohorts_named(ex.cohorts(top, users, app_ids, seed, labels), applications)


def write_payload(cohort_rows: DataFrame, path: str) -> None:
    """JSON rows for the chat service; posting them is left to its own client."""
    tables.write_json(cohort_rows, path)
