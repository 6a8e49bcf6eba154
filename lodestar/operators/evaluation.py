"""Offline evaluation of ranked lists and comparison of approaches.

Lists hold (approach, user_id, item_id, rank, relevance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import events as E
from lodestar.functions import vectors as V
from lodestar.functions.numbering import weighted_below
from lodestar.sources.storage import cut_lineage


def mark_relevance(lists: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add ``relevance``: 1 when the pair occurs among the outcomes."""
    hits = outcomes.select("user_id", "item_id").distinct().withColumn("relevance", F.lit(1))
    return lists.join(hits, ["user_id", "item_id"], "left").withColumn(
        "relevance", F.coalesce("relevance", F.lit(0))
    )


def auc(scored: DataFrame, groups: list[str]) -> DataFrame:
    """ROC AUC of (groups, score, label) rows; tied scores count half."""
    counts = scored.groupBy(*groups, "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"), F.count("*").alias("n")
    )
    return auc_of_counts(counts, groups)


def auc_of_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """AUC from (groups, score, pos, n): positives and rows of each score."""
    ranked = weighted_below(counts, groups, "score", "n")
    # Products of counts pass 64 bits at a few billion rows, so they are decimals.
    doubled_rank = (2 * F.col("below") + F.col("n") + 1).cast("decimal(20,0)")
    sums = ranked.groupBy(*groups).agg(
        F.sum((doubled_rank * F.col("pos").cast("decimal(17,0)")).cast("decimal(38,0)")).cast("double").alias("r2"),
        F.sum("pos").alias("n1"),
        F.sum(F.col("n") - F.col("pos")).alias("n0"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    area = F.try_divide(F.col("r2") / 2.0 - n1 * (n1 + 1.0) / 2.0, n1 * n0)
    return sums.select(*groups, area.alias("auc"))


def ndcg_at_k(lists: DataFrame, k: int = 10) -> DataFrame:
    """Mean NDCG per approach; the ideal order is taken from the whole list."""
    ideal = Window.partitionBy("approach", "user_id").orderBy(F.desc("relevance"))
    placed = lists.withColumn("ideal_rank", F.row_number().over(ideal))

    def gain(rank: str) -> Column:
        return F.sum(F.when(F.col(rank) <= k, F.col("relevance") / F.log2(F.col(rank) + 1.0)))

    per_user = placed.groupBy("approach", "user_id").agg(
        gain("rank").alias("dcg"), gain("ideal_rank").alias("idcg")
    )
    ratio = E.safe_ratio(F.col("dcg"), F.col("idcg"))
    return per_user.groupBy("approach").agg(F.avg(ratio).alias("ndcg"))


def mrr(lists: DataFrame) -> DataFrame:
    """Mean reciprocal rank of the first relevant item; 0 for users without one."""
    first = F.min(F.when(F.col("relevance") > 0, F.col("rank")))
    per_user = lists.groupBy("approach", "user_id").agg(first.alias("first"))
    value = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    return per_user.groupBy("approach").agg(F.avg(value).alias("mrr"))


def catalog_coverage(lists: DataFrame, catalogue: DataFrame) -> DataFrame:
    size = catalogue.agg(F.count("*")).scalar()
    shown = lists.select("approach", "item_id").distinct()
    counts = shown.groupBy("approach").agg(F.count("*").alias("recommended"))
    return counts.select("approach", E.safe_ratio(F.col("recommended"), size).alias("coverage"))


def diversity(rows: DataFrame, items: DataFrame, groups: list[str], dim: int) -> DataFrame:
    """1 - mean pairwise cosine of the vectors of each group; 0 below two items.

    The sum over pairs is |sum of unit vectors|^2 - number of them, so a group
    of any size is one map-side-combined sum; equal items are counted first.
    """
    counted = rows.groupBy(*groups, "item_id").agg(F.count("*").alias("times"))
    unit = items.filter(F.col("embedding").isNotNull()).select(
        "item_id", V.l2_normalize(F.col("embedding")).alias("unit")
    )
    joined = counted.join(unit, "item_id")
    own = F.sum(F.col("times") * V.dot(F.col("unit"), F.col("unit")))
    sums = joined.groupBy(*groups).agg(
        V.vector_sum("unit", dim, "times").alias("total"),
        own.alias("own"),
        F.sum("times").alias("n"),
    )
    pairs = F.col("n").cast("double") * (F.col("n") - 1)
    mean = (V.dot(F.col("total"), F.col("total")) - F.col("own")) / pairs
    return sums.select(*groups, F.when(F.col("n") < 2, 0.0).otherwise(1.0 - mean).alias("diversity"))


def evaluation_report(lists: DataFrame, items: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """AUC, NDCG, MRR, coverage and mean intra-list diversity per approach.

    The lists feed five metrics, so they are stored once.
    """
    lists = cut_lineage(lists)
    scored = lists.select("approach", (1.0 / F.col("rank")).alias("score"), F.col("relevance").alias("label"))
    spread = diversity(lists, items, ["approach", "user_id"], dim)
    parts = [
        auc(scored, ["approach"]),
        ndcg_at_k(lists, k),
        mrr(lists),
        catalog_coverage(lists, items),
        spread.groupBy("approach").agg(F.avg("diversity").alias("diversity")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.join(part, "approach")
    return report


def replay_summary(lists: DataFrame, outcomes: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """Headline metrics per approach from logged outcomes of the shown pairs.

    ``outcomes`` holds (user_id, item_id, clicks, dwell_ms); an impression
    counts as clicked when the user clicked that item in the replayed period.
    """
    shown = cut_lineage(lists.select("approach", "user_id", "item_id"))
    joined = shown.join(outcomes, ["user_id", "item_id"], "left")
    clicked = F.coalesce((F.col("clicks") > 0).cast("int"), F.lit(0))
    per_user = joined.groupBy("approach", "user_id").agg(
        F.count("*").alias("impressions"),
        F.sum(clicked).alias("clicks"),
        F.sum(F.coalesce("dwell_ms", F.lit(0))).alias("dwell_ms"),
    )
    totals = per_user.groupBy("approach").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum("dwell_ms").alias("dwell_ms"),
        F.count_if(F.col("clicks") > 0).alias("returning"),
        F.count("*").alias("users"),
    )
    spread = diversity(shown, items, ["approach"], dim)
    return totals.join(spread, "approach").select(
        "approach",
        "clicks",
        "impressions",
        E.safe_ratio(F.col("clicks"), F.col("impressions")).alias("ctr"),
        E.safe_ratio(F.col("dwell_ms"), F.col("impressions")).alias("avg_dwell_ms"),
        E.safe_ratio(F.col("returning"), F.col("users")).alias("return_rate"),
        "diversity",
    )


def ctr_lift(summary: DataFrame, main: str) -> DataFrame:
    """Relative CTR gain of one approach over each other one; infinite over zero."""
    own = summary.filter(F.col("approach") == main).agg(F.max("ctr")).scalar()
    others = summary.filter(F.col("approach") != main).select("approach", "ctr", own.alias("own"))
    lift = F.when(F.col("ctr") > 0, F.try_divide(F.col("own") - F.col("ctr"), F.col("ctr")))
    return others.select("approach", F.coalesce(lift, F.lit(float("inf"))).alias("lift"))
