"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import cut_lineage


def _points_to_least(links: DataFrame) -> DataFrame:
    """Every node ``a`` of both ends with its smallest neighbour, or itself, as ``m``."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node that has a link.

    ``links`` has two columns of one orderable type. The number of rounds grows
    with the logarithm of the longest chain. A node with very many links is
    reduced by partial minima and met again in a plain join that Spark can
    split; no task gathers a node's neighbours. Each round is a stored table,
    so a lost executor costs one round at most.
    """
    left, right = links.columns
    a, b = F.col(left), F.col(right)
    links = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links = cut_lineage(links)
    before = _fingerprint(links)
    for _ in range(most):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _points_to_least(both)
        # Large star: larger neighbours move to the least one.
        links = (
            both.join(least, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .distinct()
        )
        # Small star: smaller neighbours move to the least of them.
        links = cut_lineage(links)
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = (
            links.join(least, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
            .select(F.col("x.a").alias("a"), F.col("x.m").alias("b"))
            .where("a != b")
            .distinct()
        )
        links = cut_lineage(links)
        now = _fingerprint(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
