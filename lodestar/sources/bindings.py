"""The recommendation data model on top of the benchmark's parquet tables.

Every property is a lazy DataFrame over the whole table; columns that a query
does not use are pruned from the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.sources.storage import ship_package

NOW = "2024-01-31 00:00:00"
HOLDOUT_START = "2024-01-24 00:00:00"

# (name, control_low, control_high, treatment_low, treatment_high, status)
EXPERIMENTS = [
    ("two_tower_v1_vs_baseline", 0, 50, 50, 100, "active"),
    ("ranker_v2", 0, 50, 50, 90, "active"),
    ("old_exp", 0, 50, 50, 100, "stopped"),
]


def now() -> Column:
    return E.timestamp_lit(NOW)


def holdout_start() -> Column:
    return E.timestamp_lit(HOLDOUT_START)


def _pick(names: list[str], position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (position + 1).cast("int"))


class Tables:
    """Lazily bound tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def interactions(self) -> DataFrame:
        return bind_interactions(self.raw("events"))

    @cached_property
    def event_replay(self) -> DataFrame:
        """Interactions plus copies: 5 % after 30 minutes, 5 % after 2 hours."""
        base = self.interactions
        soon = base.filter("event_id % 20 = 0").withColumn(
            "created_at", F.expr("created_at + interval 30 minutes")
        )
        late = base.filter("event_id % 20 = 1").withColumn(
            "created_at", F.expr("created_at + interval 2 hours")
        )
        return base.unionByName(soon).unionByName(late)

    @cached_property
    def items(self) -> DataFrame:
        vectors = self.raw("embeddings")
        parts = self.raw("part").select(
            F.col("p_partkey").alias("item_id"), F.col("p_name").alias("content_text")
        )
        items = vectors.select(
            F.col("vec_id").alias("item_id"),
            _pick(C.CATEGORIES, F.col("label")).alias("category"),
            "embedding",
            (now() - F.make_dt_interval(hours=(F.col("vec_id") * 3).cast("int"))).alias("created_at"),
        )
        return items.join(parts, "item_id", "left")

    @cached_property
    def users(self) -> DataFrame:
        first_seen = self.raw("events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
        known = self.raw("customer").select(F.col("c_custkey").alias("user_id"))
        categories = F.array(
            _pick(C.CATEGORIES, F.col("user_id") % 10),
            _pick(C.CATEGORIES, (F.col("user_id") * 7 + 3) % 10),
        )
        users = first_seen.join(known, "user_id", "left_semi").select(
            "user_id",
            "created_at",
            _pick(C.DEVICES, F.col("user_id") % 4).alias("device"),
            categories.alias("onboarding_categories"),
        )
        return users.withColumn(
            "metadata", F.to_json(F.struct("device", "onboarding_categories"))
        )

    @cached_property
    def purchases(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("created_at"),
        )
        return lines.join(orders, "l_orderkey").select(
            "user_id", "item_id", "created_at", F.lit("save").alias("event_type")
        )

    @cached_property
    def experiments(self) -> DataFrame:
        return self.spark.createDataFrame(
            EXPERIMENTS,
            "name string, control_low int, control_high int, "
            "treatment_low int, treatment_high int, status string",
        )

    @cached_property
    def impressions(self) -> DataFrame:
        """One row per (user, day, item) shown, with whether it was clicked."""
        shown = self.interactions.filter(E.is_impression(F.col("event_type")))
        return shown.groupBy("user_id", F.to_date("created_at").alias("day"), "item_id").agg(
            F.max((F.col("event_type") == "click").cast("int")).alias("clicked")
        )


def bind_interactions(events: DataFrame) -> DataFrame:
    """Behavioural events from the raw event table (batch or streaming)."""
    even = F.col("event_id") % 2 == 0

    def either(first: str, second: str) -> Column:
        return F.when(even, first).otherwise(second)

    kind = F.col("event_type")
    event_type = (
        F.when(kind == "view", either("view_full", "view_scroll_past"))
        .when(kind == "click", "click")
        .when(kind == "purchase", either("share", "save"))
        .when(kind == "signup", either("dwell", "skip"))
        .when(kind == "error", either("hide", "report"))
    )
    client_timestamp = (
        F.when(F.col("event_id") % 10 == 0, F.lit(None))
        .when(F.col("event_id") % 97 == 0, F.expr("ts - interval 8 days"))
        .otherwise(F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)")))
    )
    named = events.select(
        "event_id",
        "user_id",
        "value",
        "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        event_type.alias("event_type"),
        client_timestamp.alias("client_timestamp"),
    )
    has_dwell = F.col("event_type").isin("click", "dwell")
    return named.select(
        "event_id",
        "user_id",
        "item_id",
        "event_type",
        F.when(has_dwell, F.round(F.col("value") * 1000).cast("int")).alias("dwell_ms"),
        F.col("ts").alias("created_at"),
        "client_timestamp",
        _pick(C.DEVICES, F.col("user_id") % 4).alias("device"),
        F.concat(F.lit("key"), (F.col("user_id") % 3).cast("string")).alias("api_key"),
        F.when(F.col("event_id") % 20 == 0, "canary").otherwise("baseline").alias("model_version"),
        F.col("value").alias("latency_ms"),
        "value",
    )
