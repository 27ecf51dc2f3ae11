"""Range-scaled score and quantile grade."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.operators.order_stats import quantiles
from zealmark.schemas import METRICS, enforce_schema

# lower and upper cut of the grades
LEAD_CUTS = (0.20, 0.80)
TOPIC_CUTS = (0.33, 0.66)


def zero_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL becomes 0, and '0' in text columns, over all or the chosen columns."""
    return df.fillna(0, subset=columns).fillna("0", subset=columns)


def ranges(df: DataFrame, metrics: tuple[str, ...] | list[str]) -> dict[str, tuple[float, float]]:
    """Lowest and highest value of each metric, over the whole frame: one row to the driver."""
    row = df.agg(*[F.struct(F.min(m), F.max(m)).alias(m) for m in metrics]).first()
    return {m: (row[m][0], row[m][1]) for m in metrics}


def range_score(
    df: DataFrame,
    metrics: tuple[str, ...] | list[str] = METRICS,
    out: str = "zscore",
    zero_range: str = "reference",
    undefined: str = "null",
) -> DataFrame:
    """Sum of metric / (max - min) over ``metrics``, in their order. ``df`` is read twice: hand over a stored frame.

    A metric that is the same on every row has no range. With
    ``zero_range="reference"`` dividing by it makes the score undefined (all
    zero) or infinite (any other value); ``undefined`` says what an undefined
    score becomes: "null", "zero" or "error". ``zero_range="ignore"`` leaves the
    metric out.
    """
    bounds = ranges(df, metrics)
    if all(low is None for low, _ in bounds.values()):
        return df.withColumn(out, F.lit(None).cast("double"))
    flat = {m: low for m, (low, high) in bounds.items() if low == high}
    if zero_range == "ignore":
        metrics = [m for m in metrics if m not in flat]
    elif zero_range != "reference":
        raise ValueError(f"unknown zero_range {zero_range!r}")
    elif any(value == 0 for value in flat.values()):
        if undefined == "error":
            raise ValueError(f"score undefined, no range in: {', '.join(flat)}")
        return df.withColumn(out, F.lit(0.0 if undefined == "zero" else None).cast("double"))
    elif flat:
        return df.withColumn(out, F.lit(math.inf))
    score: Column = F.lit(0.0)
    for place, metric in enumerate(metrics):
        low, high = bounds[metric]
        term = F.col(metric).cast("double") / F.lit(float(high - low))
        score = term if place == 0 else score + term
    return df.withColumn(out, score)


def grade(
    df: DataFrame,
    score: str,
    cuts: tuple[float, float],
    out: str = "grade_score",
) -> DataFrame:
    """C up to the lower quantile of the score, B up to the upper one, A above; NULL without a score."""
    low, high = quantiles(df, score, list(cuts))
    s = F.col(score)
    letter = F.when(s <= F.lit(low), "C").when(s <= F.lit(high), "B").when(s.isNotNull(), "A")
    return df.withColumn(out, letter)


def lead_scores(actions: DataFrame, zero_range: str = "reference", cuts: tuple[float, float] = LEAD_CUTS) -> DataFrame:
    """Score and grade one batch of actions, over all applications together.

    Missing values become 0 first, also a missing track or filter (the text '0').
    """
    scored = range_score(zero_missing(actions), METRICS, "zscore", zero_range, undefined="zero")
    return enforce_schema(grade(scored, "zscore", cuts), "scores")
