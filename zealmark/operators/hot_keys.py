"""Outer joins whose hot keys are split over many tasks.

Spark splits a skewed partition of an inner or one-sided join by itself, but not
of a full outer join: a copied right row could come out unmatched from one task
and matched from another.  Here the keys that hold many rows are found by
counting both sides first.  That also says of each whether the other side has it
at all, so rows without a partner need no join and come out exactly once, and
what is left of a hot key is an inner join, which can be cut into a grid: left
rows are dealt over one axis, right rows over the other, and each is copied along
the axis it is not dealt over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.session import stage

# Rows of one key, on one side, that a task may hold; beyond it the key is split.
HOT_ROWS = 200_000


def _equal(left: str, right: str, on: Sequence[str]) -> Column:
    return F.expr(" and ".join(f"{left}.`{k}` = {right}.`{k}`" for k in on))


def count_hot(left: DataFrame, right: DataFrame, on: Sequence[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows on a side: (keys, n_left, n_right), stored.

    One grouping over the keys of both sides, added up before its shuffle; NULL
    in a key matches nothing and is never hot.  There is one row for every
    ``limit`` rows of input at most.
    """
    sides = [
        df.select(*[F.col(f"`{k}`") for k in on], F.lit(int(is_left)).alias("n_left"), F.lit(int(not is_left)).alias("n_right"))
        for df, is_left in ((left, True), (right, False))
    ]
    counted = sides[0].unionByName(sides[1]).dropna(subset=list(on)).groupBy(*on).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return stage(counted.where((F.col("n_left") > limit) | (F.col("n_right") > limit)), "hot-keys")


def _pack(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def _dealt(packed: DataFrame, name: str, hot: DataFrame, on: Sequence[str], axis: str, across: str) -> DataFrame:
    """Rows of keys that are hot and on both sides, with their place on one axis, copied along the other.

    The place comes from the row's own values, so a repeated task deals the same way.
    """
    met = packed.join(hot.where("n_left > 0 and n_right > 0"), _equal(name, "hot", on))
    placed = met.select(name, F.pmod(F.xxhash64(name), F.col(axis)).alias(f"_{axis}"), F.col(across).alias("_n"))
    return placed.select(name, f"_{axis}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias(f"_{across}"))


def split_outer_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "full", limit: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Equality join of kind ``how`` (full, left or inner) as the columns ``a`` and ``b``, structs of either side (NULL where missing).

    Same rows as Spark's own join.  No cell of a hot key takes more than about
    ``limit`` rows of either side.  Both sides are read more than once, so they
    should be stored; rows that agree in every column are dealt to one place.
    """
    hot = count_hot(left, right, on, limit) if hot is None else hot
    a, b = _pack(left, "a"), _pack(right, "b")
    if hot.isEmpty():
        return a.join(b, _equal("a", "b", on), how)
    axes = hot.withColumns({"rows": F.ceil(F.col("n_left") / limit), "cols": F.ceil(F.col("n_right") / limit)}).alias("hot")

    def cold(packed: DataFrame, name: str) -> DataFrame:
        return packed.join(hot.alias("hot"), _equal(name, "hot", on), "left_anti")

    def alone(packed: DataFrame, name: str, other: str, missing: str) -> DataFrame:
        kept = packed.join(hot.where(f"{missing} = 0").alias("hot"), _equal(name, "hot", on), "left_semi")
        shape = (b if other == "b" else a).schema[other].dataType
        return kept.withColumn(other, F.lit(None).cast(shape)).select("a", "b")

    grid = _equal("a", "b", on) & (F.col("l._rows") == F.col("r._rows")) & (F.col("l._cols") == F.col("r._cols"))
    met = _dealt(a, "a", axes, on, "rows", "cols").alias("l").join(_dealt(b, "b", axes, on, "cols", "rows").alias("r"), grid).select("a", "b")
    out = cold(a, "a").join(cold(b, "b"), _equal("a", "b", on), how).select("a", "b").unionByName(met)
    if how in ("full", "left"):
        out = out.unionByName(alone(a, "a", "b", "n_right"))
    if how == "full":
        out = out.unionByName(alone(b, "b", "a", "n_left"))
    return out
