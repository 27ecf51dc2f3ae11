"""Outer joins with split keys against Spark's own join."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tests.test_combine import row, side
from zealmark.operators.combine import MATCH, combine
from zealmark.operators.hot_keys import count_hot, split_outer_join
from zealmark.operators.touchpoints import meet
from zealmark.session import stage

ON = ["k", "t"]


def plain(left, right, how):
    a = left.select(F.struct(*left.columns).alias("a"))
    b = right.select(F.struct(*right.columns).alias("b"))
    return a.join(b, F.expr("a.k = b.k and a.t = b.t"), how)


def as_rows(df):
    return sorted(str(r) for r in df.select("a", "b").collect())


@pytest.fixture(scope="module")
def sides(spark):
    """A key of a third of the rows on both sides, one that only the left side has, one only the right, NULL keys, and the rest."""
    left = [("hot", "x", i) for i in range(300)] + [("left only", "x", i) for i in range(90)] + [(None, "x", 1), ("hot", None, 2)] * 20
    left += [(f"k{i % 150}", "x", i) for i in range(400)]
    right = [("hot", "x", i) for i in range(70)] + [("right only", "x", i) for i in range(80)] + [(None, "x", 5)] * 30
    right += [(f"k{i % 90 + 100}", "x", i) for i in range(60)] + [("many right", "x", i) for i in range(50)]
    left += [("many right", "x", 7)]
    return stage(spark.createDataFrame(left, "k string, t string, v int"), "left"), stage(spark.createDataFrame(right, "k string, t string, w int"), "right")


@pytest.mark.parametrize("how", ["full", "left", "inner"])
@pytest.mark.parametrize("limit", [1, 16, 100, 10_000])
def test_rows_are_those_of_the_plain_join(sides, how, limit):
    assert as_rows(split_outer_join(*sides, ON, how, limit)) == as_rows(plain(*sides, how))


def test_hot_keys_are_counted_on_both_sides(sides):
    hot = {r.k: (r.n_left, r.n_right) for r in count_hot(*sides, ON, 40).collect()}
    assert hot == {"hot": (300, 70), "left only": (90, 0), "right only": (0, 80), "many right": (1, 50)}


def test_empty_sides(spark, sides):
    none = spark.createDataFrame([], sides[1].schema)
    assert as_rows(split_outer_join(sides[0], none, ON, "full", 16)) == as_rows(plain(sides[0], none, "full"))
    assert split_outer_join(sides[0].limit(0), none, ON, "full", 16).count() == 0


def test_no_task_holds_much_more_than_the_others(spark):
    """A key of a third of the rows: its pairs come from all tasks alike, and from one task without the split."""
    left = stage(spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), F.lit(0).alias("t"), F.col("id").alias("v")), "left")
    right = stage(spark.range(180).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id") + 1000).alias("k"), F.lit(0).alias("t"), F.col("id").alias("w")), "right")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)

        def per_task(df):
            pairs = df.where("a.k = 0").groupBy(F.spark_partition_id()).count().collect()
            return sorted(r[1] for r in pairs)

        split = per_task(split_outer_join(left, right, ON, "full", 10))
        assert sum(split) == 60_000 and len(split) == 8
        assert max(split) <= 2 * statistics.median(split)
        assert per_task(plain(left, right, "full")) == [60_000]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_an_item_of_half_the_rows_is_no_hot_task(spark):
    """The content is not broadcast; the rows of one item come from all tasks, and only its content is copied."""
    per_item = stage(spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("itemid"), F.col("id").alias("n")), "per-item")
    content = stage(spark.range(4000).select(F.col("id").alias("itemid"), F.lit("s").alias("session_name")).unionByName(spark.sql("select 7L as itemid, 't' as session_name")), "content")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)

        def per_task(df):
            return sorted(r[1] for r in df.where("itemid = 7").groupBy(F.spark_partition_id()).count().collect())

        split = meet(per_item, content, "itemid", 20)
        tasks = per_task(split)
        assert sum(tasks) == 4002 and len(tasks) == 8 and max(tasks) <= 2 * statistics.median(tasks)
        assert per_task(meet(per_item, content, "itemid")) == [4002]
        assert sorted(map(str, split.collect())) == sorted(map(str, meet(per_item, content, "itemid").collect()))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_combine_is_the_same_with_split_keys(frame):
    left = [row(1 + d % 27, d) for d in range(1, 40)] + [row(2, 3, item=2), row(3, 4, track=None)] + [row(4, 5, item=3) for _ in range(9)]
    right = [row(1 + d % 25, d) for d in range(1, 20)] + [row(9, 1, item=4) for _ in range(8)] + [row(5, 6, track=None)]
    sides = side(frame, left, "num_bookmarks"), side(frame, right, "num_checkins")
    for how in ("full", "left"):
        once = combine(*sides, "num_checkins", [], how, ("num_bookmarks",))
        split = combine(*sides, "num_checkins", [], how, ("num_bookmarks",), hot_rows=4)
        columns = once.columns
        assert sorted(map(str, split.select(columns).collect())) == sorted(map(str, once.collect()))
        assert set(MATCH) <= set(split.columns)
