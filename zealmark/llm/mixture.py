"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same sources form a pattern.  The flow sends
words from patterns to source quotas; a pattern's first ``size`` words cost
nothing and each further copy of it costs more than the one before (convex), so
nothing is repeated while unused text can still serve a quota.  Patterns and
sources reach the driver (their number is checked against a bound), documents never
do: those of a pattern are taken in a seeded order, found by two levels of hash
buckets whose sums locate the cut, and only the one bucket that a cut falls into is filled
document by document.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import WORDS, prepare
from zealmark.session import stage

CYCLE = (5, 2, 1)
SHARE = (3, 2)  # 150% of all words
COPIES = 2
MAX_PATTERNS = 200_000  # patterns the driver solves for: one row each
BUCKET_ROWS = 512
FAN_OUT = 1024
SEED = 20_240_611


def word_count(text: str) -> Column:
    """Number of runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")


def quotas(sizes: dict[str | None, int], cycle: Sequence[int] = CYCLE, share: tuple[int, int] = SHARE, copies: int = COPIES) -> dict[str | None, float]:
    """Target words per source.

    Sources by code point, null last, get the weights of ``cycle`` in turn and
    share ``share`` of all words; no target goes over ``copies`` times its
    source's size, and what is over goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    left, free, target = sum(sizes.values()) * share[0] / share[1], set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in order if s in free and weight[s] * unit >= copies * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = float(copies * sizes[s])
            free.discard(s)
        left = max(0.0, left - sum(target[s] for s in full))
    if free:
        unit = left / sum(weight[s] for s in free)
    return target | {s: weight[s] * unit for s in order if s in free}


def min_cost_flow(patterns: dict[tuple, int], target: dict, copies: int = COPIES) -> dict[tuple, list[dict]]:
    """Words per pattern and copy, as ``{pattern: [{source: words} of copy 1, of copy 2, ...]}``.

    Successive shortest paths from the cheapest copy upwards.  Patterns of one
    source need no search.  Others are linked through the sources they share; a path
    may push words that a pattern gave one source over to another one.
    """
    used = {p: [defaultdict(float) for _ in range(copies)] for p in patterns}
    need = {s: t for s, t in target.items()}
    of = defaultdict(list)
    for p in sorted(patterns, key=repr):
        for s in p:
            of[s].append(p)
    room = {(p, c): float(n) for p, n in patterns.items() for c in range(copies)}
    single = [p for p in patterns if len(p) == 1 and len(of[p[0]]) == 1]
    for p in single:
        s = p[0]
        for c in range(copies):
            sent = min(room[p, c], need[s])
            if sent > 0:
                used[p][c][s] += sent
                room[p, c] -= sent
                need[s] -= sent
    alone = {p[0] for p in single}
    order = sorted((s for s in of if s not in alone), key=lambda s: (s is None, s or ""))
    for c in range(copies):
        for s in order:
            while need.get(s, 0) > 1e-6:
                # cheapest way from copy c of any pattern to s: over sources that give up words of a shared pattern
                before: dict = {s: None}
                queue, found = [(0, 0, s)], None
                tick = 0
                while queue and found is None:
                    steps, _, at = heapq.heappop(queue)
                    for p in of[at]:
                        if room[p, c] > 1e-9:
                            found = (at, p)
                            break
                        for k in range(c + 1):
                            for other, words in used[p][k].items():
                                if words > 1e-9 and other not in before:
                                    before[other] = (at, p, k)
                                    tick += 1
                                    heapq.heappush(queue, (steps + 1, tick, other))
                if found is None:
                    break
                sent, at = min(need[s], room[found[1], c]), found[0]
                while before[at] is not None:
                    to, p, k = before[at]
                    sent, at = min(sent, used[p][k][at]), to
                at = found[0]
                room[found[1], c] -= sent
                used[found[1]][c][at] += sent
                while before[at] is not None:
                    to, p, k = before[at]
                    used[p][k][at] -= sent
                    used[p][k][to] += sent
                    at = to
                need[s] -= sent
    return used


def _fill(cuts: dict[tuple, list[tuple[float, int]]]):
    """Documents of a bucket that cuts fall into: larger ones first, each copy while it fits what is left of the cut."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "hash", "doc_key"], ascending=[False, True, True]).reset_index(drop=True)
        copies = pd.Series(0, index=rows.index, dtype="int64")
        begin, total = float(rows["begin"].iloc[0]), float((rows["size"] * rows["n"]).sum())
        for words, _ in cuts[key[0]]:
            left = min(max(0.0, words - begin), total)
            taken = []
            for size in rows["size"] * rows["n"]:
                take = size <= left
                left -= size * take
                taken.append(int(take))
            missed = rows.index[[not t for t in taken]]
            if len(missed):  # the one that overshoots least, if that is nearer than what is missing
                last = missed[-1]
                size = float(rows["size"][last] * rows["n"][last])
                if abs(size - left) < left:
                    taken[last] = 1
            copies += pd.Series(taken, dtype="int64")
        return rows.assign(copies=copies)[["pattern", "doc_key", "size", "copies"]]

    return fill


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, seed: int = SEED, **how) -> DataFrame:
    """``docs`` with size, source_size, target, taken, copies.

    ``sources`` is a document's array of sources (default: its column
    ``source`` alone, null being a source of its own); an empty array is the
    null source.  With several sources source_size and target are sums over
    them.  ``taken`` is size times copies.  Rows that share id, pattern and
    size are taken together; null texts have size 0 and are never short of
    their copies.  Reruns agree, as the order is a hash of id and seed.
    """
    spark = prepare(docs.sparkSession)
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    keyed = docs.withColumns(
        {
            "__sources": F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string"))),
            "__size": word_count(text_col),
            "__key": F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")),
        }
    ).withColumn("__pattern", F.to_json("__sources", {"ignoreNullFields": "false"}))
    narrow = stage(
        keyed.select(
            F.col("__pattern").alias("pattern"),
            F.col("__sources").alias("sources"),
            F.col("__size").alias("size"),
            F.col("__key").alias("doc_key"),
            F.xxhash64(F.lit(seed), "__key").alias("hash"),
        ),
        "mix-sizes",
    )
    summed = narrow.groupBy("pattern", "sources").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = summed.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group the sources first")
    names = {row.pattern: tuple(row.sources) for row in rows}
    sizes: dict = defaultdict(int)
    for row in rows:
        for s in row.sources:
            sizes[s] += row.size
    target = quotas(sizes, **how)
    copies = how.get("copies", COPIES)
    flow = min_cost_flow({names[row.pattern]: row.size for row in rows}, target, copies)
    cuts = {row.pattern: [(float(sum(flow[names[row.pattern]][c].values())), c) for c in range(copies)] for row in rows}

    # two levels of hash buckets of about BUCKET_ROWS documents, and the words before each
    plan = spark.createDataFrame(
        [(row.pattern, -(-row.n // BUCKET_ROWS), float(row.size), *[cuts[row.pattern][c][0] for c in range(copies)]) for row in rows],
        "pattern string, buckets bigint, all_words double, " + ", ".join(f"cut{c} double" for c in range(copies)),
    )
    at = F.pmod(F.col("hash"), F.col("buckets"))
    placed = narrow.drop("sources").join(F.broadcast(plan.select("pattern", "buckets")), "pattern")  # at most MAX_PATTERNS rows
    placed = placed.select("pattern", "doc_key", "hash", "size", F.floor(at / FAN_OUT).alias("high"), at.alias("bucket"))
    sums = stage(placed.groupBy("pattern", "high", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    before = "rows between unbounded preceding and 1 preceding"
    highs = sums.groupBy("pattern", "high").agg(F.sum("words").alias("high_words"))
    highs = highs.selectExpr("pattern", "high", f"coalesce(sum(high_words) over (partition by pattern order by high {before}), 0) as high_begin")
    begins = sums.selectExpr("*", f"coalesce(sum(words) over (partition by pattern, high order by bucket {before}), 0) as inner_begin").join(highs, ["pattern", "high"])
    whole = sum((F.when(F.col("begin") + F.col("words") <= F.col(f"cut{c}"), 1).otherwise(0) for c in range(copies)), F.lit(0))
    part = F.lit(False)
    for c in range(copies):
        part = part | ((F.col("begin") < F.col(f"cut{c}")) & (F.col("begin") + F.col("words") > F.col(f"cut{c}")))
    marked = begins.withColumn("begin", (F.col("high_begin") + F.col("inner_begin")).cast("double")).join(F.broadcast(plan), "pattern")
    marked = stage(marked.select("pattern", "bucket", "begin", whole.cast("bigint").alias("whole"), part.alias("part")), "mix-marked")

    # at most one bucket per cut is filled document by document
    inside = placed.join(marked.where("part").select("pattern", "bucket", "begin"), ["pattern", "bucket"])
    inside = inside.groupBy("pattern", "bucket", "begin", "doc_key", "hash", "size").agg(F.count("*").alias("n"))
    fill = _fill(cuts)
    filled = inside.groupBy("pattern", "bucket").applyInPandas(lambda key, rows: fill(key, rows), "pattern string, doc_key string, size bigint, copies bigint")
    picks = stage(filled, "mix-picks")

    about = [(row.pattern, float(sum(target[s] for s in names[row.pattern])), sum(sizes[s] for s in names[row.pattern]), -(-row.n // BUCKET_ROWS)) for row in rows]
    about = spark.createDataFrame(about, "__pattern string, __target double, __source_size bigint, __buckets bigint")
    out = keyed.join(F.broadcast(about), "__pattern").withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), "__key"), F.col("__buckets")))
    out = out.join(marked.selectExpr("pattern as __pattern", "bucket as __bucket", "whole as __whole", "part as __part"), ["__pattern", "__bucket"])
    out = out.join(picks.selectExpr("pattern as __pattern", "doc_key as __key", "size as __size", "copies as __picked"), ["__pattern", "__key", "__size"], "left")
    taken = F.when(F.col("__part"), F.coalesce("__picked", F.lit(0))).otherwise(F.col("__whole"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    return out.select(
        *kept,
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * taken).cast("bigint").alias("taken"),
        taken.cast("bigint").alias("copies"),
    )
