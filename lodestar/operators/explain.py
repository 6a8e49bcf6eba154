"""Attribution of scores to the ranking features."""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.operators.ranking import ranker_scores

NAMES = C.RANKING_FEATURES


def linear_attribution(features: DataFrame, weights: list[float]) -> DataFrame:
    """Exact Shapley values of a linear score: weight * (value - mean)."""
    means = features.agg(F.struct(*[F.avg(n).alias(n) for n in NAMES])).scalar()
    based = features.withColumn("_mean", means)
    values = {
        f"c_{n}": F.lit(w) * (F.col(n) - F.col("_mean")[n]) for n, w in zip(NAMES, weights)
    }
    return based.withColumns(values).drop("_mean")


def coalition_attribution(features: DataFrame, model: PipelineModel, keys: list[str]) -> DataFrame:
    """Exact Shapley values of any model against the mean row.

    Each row is scored under all 128 subsets of its seven features (the others
    set to their means); one aggregation weighs the scores.
    """
    n = len(NAMES)
    means = features.agg(F.struct(*[F.avg(c).alias(c) for c in NAMES])).scalar()
    masks = F.array(*[F.lit(m) for m in range(1 << n)])
    wide = features.select(*keys, *NAMES).withColumn("_mean", means).withColumn("_mask", F.explode(masks))

    def kept(i: int) -> Column:
        return F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0

    masked = wide.select(
        *keys,
        "_mask",
        *[F.when(kept(i), F.col(c)).otherwise(F.col("_mean")[c]).alias(c) for i, c in enumerate(NAMES)],
    )
    scored = ranker_scores(model, masked)
    size = F.bit_count("_mask")
    with_it = F.element_at(
        F.array(*[F.lit(factorial(s - 1) * factorial(n - s) / factorial(n) if s else 0.0) for s in range(n + 1)]),
        size + 1,
    )
    without = F.element_at(
        F.array(*[F.lit(factorial(s) * factorial(n - s - 1) / factorial(n) if s < n else 0.0) for s in range(n + 1)]),
        size + 1,
    )
    parts = [
        F.sum(F.col("score") * F.when(kept(i), with_it).otherwise(-without)).alias(f"c_{c}")
        for i, c in enumerate(NAMES)
    ]
    full, none = (1 << n) - 1, 0
    ends = [
        F.max(F.when(F.col("_mask") == full, F.col("score"))).alias("score"),
        F.max(F.when(F.col("_mask") == none, F.col("score"))).alias("base_score"),
    ]
    return scored.groupBy(*keys).agg(*parts, *ends)


def contributions() -> Column:
    """The seven contribution columns as an array of (position, feature, value)."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature"), F.col(f"c_{n}").alias("value"))
            for i, n in enumerate(NAMES)
        ]
    )


def _strongest(k: int, *entry: Callable[[int, str], Column]) -> Column:
    """The k features of largest absolute contribution with their sort keys; ties keep feature order.

    A sort of plain structs is compiled, where lambdas over an array are interpreted row by row.
    """
    keyed = [
        F.struct((-F.abs(F.col(f"c_{n}"))).alias("size"), F.lit(i).alias("i"), *[make(i, n) for make in entry])
        for i, n in enumerate(NAMES)
    ]
    return F.slice(F.sort_array(F.array(*keyed)), 1, k)


def _feature(i: int, name: str) -> Column:
    return F.lit(name).alias("feature")


def _value(i: int, name: str) -> Column:
    return F.col(f"c_{name}").alias("value")


def top_features(k: int = 5) -> Column:
    """The k features of largest absolute contribution; ties keep feature order."""
    return _strongest(k, _feature, _value)


def explanation_text() -> Column:
    """Sentence for the strongest feature."""
    pairs = [F.lit(x) for pair in C.EXPLANATIONS.items() for x in pair]
    strongest = top_features(1)[0]["feature"]
    return F.coalesce(F.element_at(F.create_map(*pairs), strongest), F.lit(C.DEFAULT_EXPLANATION))


def developer_attribution(attributed: DataFrame, model_version: str) -> DataFrame:
    """Drill-down record per recommendation: all contributions and the top five."""
    named = [x for n in NAMES for x in (F.lit(n), F.col(f"c_{n}"))]
    top = _strongest(5, lambda i, n: F.struct(_feature(i, n), _value(i, n)).alias("own"))
    return attributed.select(
        "user_id",
        "item_id",
        "rank",
        F.lit(model_version).alias("model_version"),
        F.create_map(*named).alias("feature_contributions"),
        top.getField("own").alias("top_features"),
    )


def false_attribution_rate(
    attributed: DataFrame, dominant: str = "popularity_score", threshold: float = 0.5
) -> DataFrame:
    """Share of rows in which one feature outweighs all others together."""
    if dominant not in NAMES:
        raise ValueError(f"unknown feature: {dominant}")
    total = F.lit(1e-9)
    for n in NAMES:
        total = total + F.abs(f"c_{n}")
    share = F.abs(f"c_{dominant}") / total
    return attributed.agg(
        F.count("*").alias("rows"), F.avg((share > threshold).cast("double")).alias("rate")
    )
