"""Exact order statistics of a column too long for one task's memory."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def values_at(df: DataFrame, column: str, ranks: list[int], weight: str | None = None) -> dict[int, float]:
    """Value at each 0-based rank of the sorted column (NULL-free; ``weight`` = copies of a row).

    Each pass counts every open bracket in at most ``BUCKETS`` + 1 equal slices, all
    in one job, and keeps the slices that hold a rank, with their own lowest and highest
    value. The two end values of a bracket fall into different slices, so every
    pass shrinks it until one value is left. Only slice counts leave the
    executors, however the values are distributed or repeated.
    """
    copies = F.col(weight) if weight else F.lit(1)
    x = F.col(column)
    lowest, highest = df.agg(F.min(x), F.max(x)).first()
    return _narrow(df, x, copies, [Bracket(lowest, highest, 0, sorted(set(ranks)))])


class Bracket(NamedTuple):
    """Values from ``low`` to ``high``, after ``before`` smaller rows, among which are those of ``ranks``."""

    low: float
    high: float
    before: int
    ranks: list[int]


def _narrow(df: DataFrame, x: Column, copies: Column, brackets: list[Bracket]) -> dict[int, float]:
    found: dict[int, float] = {}
    while True:
        for done in (b for b in brackets if b.low == b.high):
            found.update(dict.fromkeys(done.ranks, done.low))
        # brackets are apart from each other, so a row is in one of them at most
        brackets = [b for b in brackets if b.low != b.high]
        if not brackets:
            return found
        which, slice_no = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for n, b in enumerate(brackets):
            inside = (x >= F.lit(b.low)) & (x <= F.lit(b.high))
            which = F.when(inside, n).otherwise(which)
            slice_no = F.when(inside, F.floor((x - F.lit(b.low)) / (F.lit(b.high) - F.lit(b.low)) * BUCKETS)).otherwise(slice_no)
        counted = (
            df.select(which.alias("which"), slice_no.alias("slice"), copies.alias("copies"), x.alias("x"))
            .filter("which is not null")
            .groupBy("which", "slice")
            .agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
            .collect()
        )
        narrower = []
        for n, b in enumerate(brackets):
            before = b.before
            for part in sorted((row for row in counted if row["which"] == n), key=lambda row: row["slice"]):
                ranks = [r for r in b.ranks if before <= r < before + part["n"]]
                if ranks and part["rows"] == part["n"] == 2:
                    # two rows: the lower and the higher one
                    found.update({r: part["low"] if r == before else part["high"] for r in ranks})
                elif ranks:
                    narrower.append(Bracket(part["low"], part["high"], before, ranks))
                before += part["n"]
        brackets = narrower


def quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Interpolated quantiles (position (n-1)p between neighbours), ignoring NULL.

    One job counts the values and their range, then one job a pass narrows all quantiles together.
    """
    x = F.col(column)
    values = df.select(column).filter(x.isNotNull())
    n, lowest, highest = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if n == 0:
        return [None] * len(probs)
    positions = [(n - 1) * p for p in probs]
    ranks = sorted({r for h in positions for r in (math.floor(h), math.ceil(h))})
    at = _narrow(values, x, F.lit(1), [Bracket(lowest, highest, 0, ranks)])
    out = []
    for h in positions:
        low, high = at[math.floor(h)], at[math.ceil(h)]
        out.append(low if low == high else (math.ceil(h) - h) * low + (h - math.floor(h)) * high)
    return out
