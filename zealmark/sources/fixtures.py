"""Adapter: the driver's test tables in the shape of the event platform's tables.

Every view reads its whole source table. Conditions stand for business rules
(accounts without details, items without track), never for a smaller sample.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30 18:30:00"
VIEW_HOURS = 6  # views are logged at this width, so that one person views an item more than once at a time
ITEMS_PER_EVENT = 20
EVENTS = 5


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class Platform:
    """The platform's tables, each a DataFrame built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._scans: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = self._scan(name)
        return self._scans[name]

    def _scan(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        day = F.dayofmonth("ts")
        hours = f"cast(floor(hour(ts) / {VIEW_HOURS}) * {VIEW_HOURS} as int)"
        viewed = F.expr(f"cast(cast(ts as date) as timestamp_ntz) + make_dt_interval(0, {hours}, 0, 0)")
        return self._read("events").select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.when(F.col("event_type") == "view", viewed).otherwise(F.col("ts")).alias("created"),
            ((k % ITEMS_PER_EVENT) * EVENTS + F.col("user_id") % EVENTS).alias("k"),
            day.cast("bigint").alias("batch_id"),
            F.concat(
                F.col("user_id").cast("string"), F.lit("-w"), F.floor(day / F.lit(7.0)).cast("bigint").cast("string")
            ).alias("session_id"),
            F.concat(F.lit("App-"), (F.col("user_id") % EVENTS).cast("string")).alias("application_id"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("global_user_id"),
        )

    def _facts(self, identifier, metadata, *event_types: str) -> DataFrame:
        return self.ev.filter(F.col("event_type").isin(*event_types)).select(
            "application_id",
            "global_user_id",
            "session_id",
            "created",
            identifier.alias("identifier"),
            metadata.alias("metadata"),
            "batch_id",
            "event_id",
        )

    @property
    def _item_json(self):
        return F.concat(F.lit('{"ItemId": '), F.col("k").cast("string"), F.lit("}"))

    @cached_property
    def fact_views_live(self) -> DataFrame:
        is_view = F.col("event_type") == "view"
        return self._facts(
            F.when(is_view, "item").otherwise("list"),
            F.when(is_view | (F.col("value") >= 30), self._item_json).otherwise("{}"),
            "view",
            "click",
        )

    @cached_property
    def fact_sessions_live(self) -> DataFrame:
        return self._facts(F.lit("session"), F.lit(None).cast("string"), "error")

    @cached_property
    def fact_actions_live(self) -> DataFrame:
        return self._facts(
            F.when(F.col("value") < 60, "bookmarkButton").otherwise("likeButton"), self._item_json, "purchase"
        )

    @cached_property
    def ratings_usercheckins(self) -> DataFrame:
        return self.ev.filter(F.col("event_type") == "signup").select(
            F.col("event_id").alias("checkinid"),
            F.col("user_id").alias("userid"),
            F.upper("application_id").alias("applicationid"),
            F.col("k").alias("itemid"),
            "created",
        )

    @cached_property
    def ratings_usercheckinnotes(self) -> DataFrame:
        return self.ev.filter((F.col("event_type") == "signup") & (F.col("value") >= 15)).select(
            F.col("event_id").alias("checkinid")
        )

    @cached_property
    def ratings_item(self) -> DataFrame:
        return self._read("part").select(
            F.col("p_partkey").alias("itemid"),
            F.col("p_name").alias("name"),
            (F.floor(F.col("p_partkey") / EVENTS) % 25).cast("bigint").alias("parenttopicid"),
            F.when(F.col("p_size") == 7, 1).otherwise(0).alias("isdisabled"),
        )

    @cached_property
    def ratings_topic(self) -> DataFrame:
        return self._read("nation").select(
            F.col("n_nationkey").cast("bigint").alias("topicid"),
            F.col("n_name").alias("name"),
            F.when(F.col("n_regionkey") < 3, 2).when(F.col("n_regionkey") == 3, 4).otherwise(3).alias("listtypeid"),
            F.when(F.col("n_name") == "NATION_12", 1).otherwise(0).alias("isdisabled"),
        )

    @cached_property
    def ratings_itemmappings(self) -> DataFrame:
        part = self._read("part")
        links = F.explode(F.array(F.lit(EVENTS), F.lit(2 * EVENTS)))
        return part.select(F.col("p_partkey").alias("targetitemid"), links.alias("step")).select(
            (F.col("targetitemid") - F.col("step")).alias("sourceitemid"), "targetitemid"
        )

    @cached_property
    def ratings_itemfiltermappings(self) -> DataFrame:
        part = self._read("part")
        first = part.filter(F.col("p_size") > 10).select("p_partkey", F.col("p_size") % 25)
        second = part.filter(F.col("p_size") > 38).select("p_partkey", (F.col("p_size") + 1) % 25)
        return first.union(second).toDF("itemid", "filterid").select("itemid", F.col("filterid").cast("bigint"))

    @cached_property
    def ratings_filters(self) -> DataFrame:
        return self._read("nation").select(
            F.col("n_nationkey").cast("bigint").alias("filterid"), F.col("n_name").alias("name")
        )

    @cached_property
    def authdb_is_users(self) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        return self._read("customer").select(
            F.col("c_custkey").alias("userid"),
            F.concat(F.lit("u"), key).alias("globaluserid"),
            F.concat(F.lit("app-"), (F.col("c_custkey") % EVENTS).cast("string")).alias("applicationid"),
        )

    @cached_property
    def ratings_globaluserdetails(self) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        titles = (
            "Product Specialist",
            "SVP Sales",
            "vice president, ops",
            "Account Manager",
            "Director of IT",
            "Chief Engineer",
            "Chief of Staff",
            "CTO",
            "ceo",
            "Analyst",
            "vp sales",
        )
        title = F.lit(None).cast("string")
        for place, text in enumerate(titles):
            title = F.when(F.col("c_custkey") % 12 == place, text).otherwise(title)
        return (
            self._read("customer")
            .filter(F.col("c_acctbal") >= 0)
            .select(
                F.concat(F.lit("u"), key).alias("globaluserid"),
                title.alias("title"),
                F.concat(F.lit("user"), key, F.lit("@example.com")).alias("emailaddress"),
                F.concat(F.lit("First"), key).alias("firstname"),
                F.concat(F.lit("Last"), key).alias("lastname"),
                F.col("c_mktsegment").alias("company"),
                F.concat(F.lit("000-"), key).alias("phone"),
            )
        )

    @cached_property
    def authdb_applications(self) -> DataFrame:
        return self._read("region").select(
            F.concat(F.lit("APP-"), F.col("r_regionkey").cast("string")).alias("applicationid"),
            F.concat(F.lit("Event "), F.col("r_name")).alias("name"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("startdate"),
            F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("enddate"),
        )

    @cached_property
    def implementation(self) -> DataFrame:
        return (
            self._read("customer")
            .filter(F.col("c_mktsegment") != "FURNITURE")
            .select(F.concat(F.lit("APP-"), F.col("c_custkey").cast("string")).alias("applicationid"))
        )

    @cached_property
    def session_tags_v0(self) -> DataFrame:
        words = F.split("p_name", " ")
        topics = F.explode(F.array(words[0], words[1], F.col("p_type")))
        return self._read("part").select(
            F.col("p_partkey").alias("itemid"),
            topics.alias("topic"),
            F.concat(F.lit("APP-"), (F.col("p_partkey") % EVENTS).cast("string")).alias("applicationid"),
        )

    @cached_property
    def session_topics_manual(self) -> DataFrame:
        second = F.when(F.col("p_size") % 3 != 0, F.lower("p_type")).otherwise("misc")
        return (
            self._read("part")
            .filter(F.col("p_size") > 8)
            .select(
                F.col("p_partkey").alias("itemid"),
                F.explode(F.array(F.upper(F.split("p_name", " ")[0]), second)).alias("topic"),
            )
        )

    @cached_property
    def eventcubesummary(self) -> DataFrame:
        def count_of(kind: str):
            return F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))

        last_day = F.max("created").cast("date")
        return (
            self.ev.groupBy("user_id")
            .agg(
                F.min("created").alias("startdate"),
                F.date_add(last_day, (F.col("user_id") % 12).cast("int")).alias("enddate"),
                F.count(F.lit(1)).alias("users"),
                F.countDistinct(F.when(F.col("user_id") % 17 != 0, F.col("batch_id"))).alias("usersactive"),
                F.countDistinct(F.when(F.col("event_type") == "view", F.col("batch_id"))).alias("usersengaged"),
                count_of("click").alias("posts"),
                count_of("purchase").alias("likes"),
                count_of("signup").alias("comments"),
                count_of("error").alias("checkins"),
            )
            .withColumn("applicationid", F.concat(F.lit("app-"), F.col("user_id").cast("string")))
            .drop("user_id")
        )

    @cached_property
    def chat_responses(self) -> DataFrame:
        reply = F.col("turn") % 4
        return self._read("conversations").select(
            F.concat(F.lit("APP-"), (F.col("conv_id") % EVENTS).cast("string")).alias("application_id"),
            F.when(reply < 2, (reply + 1).cast("string")).otherwise(F.col("text")).alias("body"),
        )

    @cached_property
    def score_pairs(self) -> DataFrame:
        return self._read("embeddings").select(
            "vec_id",
            F.abs(F.col("embedding")[0].cast("double")).alias("svd_social"),
            F.abs(F.col("embedding")[1].cast("double")).alias("svd_content"),
        )
