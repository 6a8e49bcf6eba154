"""Exact global ranks and positions without a single-partition window.

A window without PARTITION BY, or over one huge group, runs in one task. Here
rows are first cut into value slices (approximate quantiles or hash ranges);
slice totals give each slice its offset, and a window per (group, slice) does
the rest. Results are exact: the quantiles only decide how the work is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.storage import cut_lineage

# Fewest and most slices; between them twice the shuffle partitions.
FEW_SLICES, MOST_SLICES = 64, 512


def slices_for(df: DataFrame) -> int:
    """As many slices as keep the session's shuffle partitions busy (results don't depend on it)."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_SLICES, max(FEW_SLICES, 2 * tasks))


def quantile_slice(df: DataFrame, value: str, slices: int | None = None) -> DataFrame:
    """Add ``_slice``: how many of ``slices - 1`` approximate quantiles are <= value."""
    slices = slices or slices_for(df)
    points = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(value, points, 10000)).scalar()
    below = F.aggregate("_cuts", F.lit(0), lambda acc, cut: acc + (F.col(value) >= cut).cast("int"))
    sliced = df.withColumn("_cuts", cuts).withColumn("_slice", F.coalesce(below, F.lit(0)))
    return sliced.drop("_cuts")


def _offsets(df: DataFrame, groups: Sequence[str], weights: dict[str, Column]) -> DataFrame:
    """Running totals over the slices before each slice (a few rows per group)."""
    totals = df.groupBy(*groups, "_slice").agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    # One row per (group, slice): small whatever the data size.
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *groups,
        "_slice",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in weights],
    )


def sliced_row_number(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], output: str
) -> DataFrame:
    """1-based row number per group of a frame that already has a ``_slice``.

    ``_slice`` must be monotone in the first order column.
    """
    offsets = _offsets(df, groups, {"n": F.lit(1)})
    local = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(*order))
    keyed = df.withColumn("_local", local)
    joined = keyed.join(offsets, [*groups, "_slice"])
    return joined.withColumn(output, (F.col("_local") + F.col("_before_n")).cast("bigint")).drop(
        "_slice", "_local", "_before_n"
    )


def global_row_number(df: DataFrame, value: str, output: str, slices: int | None = None) -> DataFrame:
    """1-based position of every row in ascending order of a unique ``value``."""
    return sliced_row_number(quantile_slice(df, value, slices), [], [F.col(value)], output)


def hash_positions(
    df: DataFrame, groups: Sequence[str], uniform: Column, ties: Sequence[str], output: str
) -> DataFrame:
    """1-based position of every row in the hash order of its group."""
    sliced = df.withColumn("_u", uniform).withColumn(
        "_slice", F.floor(F.col("_u") * slices_for(df)).cast("int")
    )
    return sliced_row_number(sliced, groups, [F.col("_u"), *map(F.col, ties)], output).drop("_u")


def weighted_below(
    counts: DataFrame, groups: Sequence[str], value: str, weight: str, slices: int | None = None
) -> DataFrame:
    """Add ``below``: total weight of strictly smaller values within the group.

    ``counts`` holds one row per (group, value).
    """
    # Read three times (quantiles, slice totals, rows), so computed once.
    return _below(cut_lineage(counts), groups, value, weight, slices)


def _below(
    counts: DataFrame, groups: Sequence[str], value: str, weight: str, slices: int | None = None
) -> DataFrame:
    sliced = quantile_slice(counts, value, slices)
    offsets = _offsets(sliced, groups, {"w": F.col(weight)})
    before = (
        Window.partitionBy(*groups, "_slice")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.withColumn("_local", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    return (
        local.join(offsets, [*groups, "_slice"])
        .withColumn("below", F.col("_local") + F.col("_before_w"))
        .drop("_slice", "_local", "_before_w")
    )


def exact_quantiles(
    counts: DataFrame, groups: Sequence[str], value: str, weight: str, quantiles: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles per group from (group, value, weight) counts.

    Unlike ``percentile``, no task holds all distinct values of a group.
    """
    counts = cut_lineage(counts)
    ranked = _below(counts, groups, value, weight)
    totals = counts.groupBy(*groups).agg(F.sum(weight).alias("_total"))
    placed = ranked.join(totals, list(groups))
    first, last = F.col("below"), F.col("below") + F.col(weight)
    picks = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("_total") - 1)
        for end, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (first <= at) & (at < last)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{end}"))
    found = placed.groupBy(*groups, "_total").agg(*picks)

    def between(name: str, q: float) -> Column:
        position = F.lit(q) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return found.select(*groups, F.col("_total").alias("n"), *[between(n, q) for n, q in quantiles.items()])
