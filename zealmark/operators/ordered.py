"""Neighbour lookups in time order that survive a group too large for one task.

A plain window sorts each group in one task. Groups above ``limit`` rows are cut
into consecutive chunks of about ``limit`` rows; the window then runs per (group,
chunk), and one boundary row per chunk carries the neighbour across the cut. The
results are the same as without cutting.

Borders are found by counting, coarse first: rows per minute, and of a minute that
alone exceeds the limit per second, millisecond, microsecond and then by digits of the
row's id, so that only rows that agree in time and id share a chunk without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zealmark.functions.columns import micros_between, moment
from zealmark.session import stage

CHUNK = "_chunk"
GROUP_LIMIT = 5_000_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    # a NULL key is a group of its own in a window, so it has to match itself here
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _digits(ts: str, tie: str | None) -> list[Column]:
    """The order by (``ts``, ``tie``) as digits, coarse first; a NULL comes first, as it does in a window."""
    micros = micros_between(moment("1970-01-01 00:00:00"), F.col(ts))
    within = F.pmod(micros, F.lit(60_000_000))
    digits = [F.floor(micros / 60e6), F.floor(within / 1e6), F.pmod(F.floor(within / 1e3), F.lit(1000)), F.pmod(within, F.lit(1000))]
    if tie is not None:
        # signed order as unsigned: the sign bit is turned over
        unsigned = F.col(tie).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
        digits += [F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit(0xFFFF)) for shift in (48, 32, 16, 0)]
    return [F.coalesce(digit.cast("bigint"), F.lit(-(1 << 62))) for digit in digits]


def attach(df: DataFrame, side: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join on NULL-safe keys; ``side`` is a stored table, so Spark knows its bytes and chooses the join."""
    side = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values)
    condition = F.lit(True)
    for key in keys:
        condition = condition & df[key].eqNullSafe(side[f"_k_{key}"])
    return df.join(side, condition, "left").drop(*[f"_k_{k}" for k in keys])


def cut_hot_groups(df: DataFrame, keys: list[str], ts: str, limit: int = GROUP_LIMIT, tie: str | None = None) -> tuple[DataFrame, bool]:
    """Add the chunk number: NULL for an ordinary group. Returns (frame, whether any group was cut).

    ``tie`` is the whole-number column that orders rows of equal ``ts``. Counting the groups costs one pass
    with partial aggregation. The chunk map holds one row per minute of a hot group, and for each cell
    above the limit (at most rows / limit of them) what it is made of on the next level. It is staged, so every
    later use sees the same borders, also after a retry. A chunk has less than twice ``limit`` rows.
    """
    hot = df.groupBy(*keys).count().filter(F.col("count") > limit).drop("count")
    if hot.isEmpty():
        return df.withColumn(CHUNK, F.lit(None).cast("bigint")), False
    crowded = stage(hot, "hot-groups")  # at most rows / limit of them, and their size is known from here on
    digits = {f"_digit{n}": digit for n, digit in enumerate(_digits(ts, tie))}
    timed, names = df.withColumns(digits), list(digits)
    cells: list[DataFrame] = []
    for level, name in enumerate(names):
        path = [*keys, *names[:level]]
        counted = timed.join(crowded, _same(timed, crowded, path), "left_semi").groupBy(*path, name).agg(F.count(F.lit(1)).alias("n"))
        counted = stage(counted.withColumn("_level", F.lit(level)), "cells")
        above = counted.filter(F.col("n") > limit)
        last = level + 1 == len(names) or above.isEmpty()
        cells.append(counted if last else counted.filter(F.col("n") <= limit))
        if last:
            break
        crowded = above.select(*path, name)
    whole = cells[0]
    for finer in cells[1:]:
        whole = whole.unionByName(finer, allowMissingColumns=True)
    used = names[: len(cells)]
    before = Window.partitionBy(*keys).orderBy(*used).rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / limit)
    chunks = stage(whole.select(*keys, *used, "_level", chunk.alias(CHUNK)), "chunks")
    for level in range(len(cells)):
        side = chunks.filter(F.col("_level") == level).withColumnRenamed(CHUNK, f"_chunk{level}")
        timed = attach(timed, side, [*keys, *used[: level + 1]], [f"_chunk{level}"])
    found = [f"_chunk{level}" for level in range(len(cells))]
    return timed.withColumn(CHUNK, F.coalesce(*found)).drop(*names, *found), True


def _across(df: DataFrame, keys: list[str], edge: Column, name: str, step) -> DataFrame:
    """Value of ``edge`` in the neighbouring chunk, one row per hot (group, chunk)."""
    edges = df.filter(F.col(CHUNK).isNotNull()).groupBy(*keys, CHUNK).agg(edge.alias("_edge"))
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    return stage(edges.select(*keys, CHUNK, step(F.col("_edge")).over(over).alias(name)), "edges")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str, cut: bool
) -> DataFrame:
    """Add struct ``name`` with ``values`` of the row before; NULL for the first row of a group."""
    row = F.struct(*values)
    over = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    out = df.withColumn(name, F.lag(row).over(over))
    if cut:
        edge = F.max_by(row, F.struct(*order))
        edges = _across(df, keys, edge, "_carried", F.lag)
        out = attach(out, edges, [*keys, CHUNK], ["_carried"])
        out = out.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    return out


def with_next_time(df: DataFrame, keys: list[str], order: list[str], ts: str, name: str, cut: bool) -> DataFrame:
    """Add ``name``, the ``ts`` of the row after; NULL for the last row of a group."""
    over = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    out = df.withColumn(name, F.lead(ts).over(over))
    if cut:
        edges = _across(df, keys, F.min(ts), "_carried", F.lead)
        out = attach(out, edges, [*keys, CHUNK], ["_carried"])
        out = out.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    return out
