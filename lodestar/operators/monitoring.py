"""Operational metrics: latency quantiles, histograms, canary comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions.numbering import exact_quantiles
from lodestar.operators.ingest import window_index


_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_quantiles(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """Exact p50, p95 and p99 per time slot."""
    slot = window_index(F.col("created_at"), seconds).alias("slot")
    counts = requests.groupBy(slot, "latency_ms").agg(F.count("*").alias("n"))
    found = exact_quantiles(counts, ["slot"], "latency_ms", "n", _QUANTILES)
    return found.select(
        "slot", F.col("n").alias("requests"), *[F.round(n, 6).alias(n) for n in _QUANTILES]
    )


def latency_quantiles_approx(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """The same with bounded state, for very long slots."""
    slot = window_index(F.col("created_at"), seconds).alias("slot")
    latency = F.col("latency_ms")
    return requests.groupBy(slot).agg(
        F.count("*").alias("requests"),
        *[F.percentile_approx(latency, q, 10000).alias(n) for n, q in _QUANTILES.items()],
    )


def cumulative_histogram(rows: DataFrame, value: Column, bounds: list[float], output: str) -> DataFrame:
    """Rows at or below each bound; the last bound is infinite."""
    bucket = F.lit(float("inf"))
    for bound in reversed(bounds):
        bucket = F.when(value <= bound, F.lit(bound)).otherwise(bucket)
    counts = rows.filter(value.isNotNull()).groupBy(bucket.alias("le")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    every = spark.createDataFrame([(b,) for b in [*bounds, float("inf")]], "le double")
    # One row per bound from here on.
    running = Window.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.join(counts, "le", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select("le", F.sum("n").over(running).alias(output))


def sustained_alerts(rows: DataFrame, keys: list[str], slots: int, slot: str = "slot") -> DataFrame:
    """Add ``sustained``: the alert has held for ``slots`` slots in a row, up to this one.

    A missing slot interrupts it. ``rows`` holds one row per key and slot.
    """
    raised = F.when(F.col("alert"), F.col(slot))
    recent = Window.partitionBy(*keys).orderBy(slot).rangeBetween(-(slots - 1), 0)
    return rows.withColumn("sustained", F.count(raised).over(recent) == slots)


def canary_gate(requests: DataFrame) -> DataFrame:
    """Whether the canary model must be rolled back against the baseline."""
    kind = F.col("event_type")
    rates = requests.groupBy("model_version").agg(
        E.safe_ratio(F.count_if(kind == "click"), F.count_if(E.is_impression(kind))).alias("ctr")
    )
    counts = requests.groupBy("model_version", "latency_ms").agg(F.count("*").alias("n"))
    tails = exact_quantiles(counts, ["model_version"], "latency_ms", "n", {"p99": 0.99})
    per_model = rates.join(tails, "model_version")

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model_version") == model, F.col(column)))

    sides = per_model.agg(
        of("canary", "ctr").alias("c_ctr"),
        of("baseline", "ctr").alias("b_ctr"),
        of("canary", "p99").alias("c_p99"),
        of("baseline", "p99").alias("b_p99"),
    )
    ctr_delta = F.col("c_ctr") - F.col("b_ctr")
    p99_delta = F.col("c_p99") - F.col("b_p99")
    return sides.select(
        F.lit("canary").alias("model_version"),
        F.round(ctr_delta, 6).alias("ctr_delta"),
        F.round(p99_delta, 6).alias("p99_delta_ms"),
        ((ctr_delta < C.CANARY_CTR_DROP) | (p99_delta > C.CANARY_LATENCY_DELTA_MS)).alias("rollback"),
        (
            (F.col("c_p99") > F.col("b_p99") * C.CANARY_LATENCY_RATIO)
            | (F.col("c_ctr") < F.col("b_ctr") * C.CANARY_CTR_RATIO)
        ).alias("rollback_relative"),
    )
