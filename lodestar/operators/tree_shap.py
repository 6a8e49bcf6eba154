"""Path-dependent Shapley values of boosted trees over the ranking features.

The value of a subset of features is what the trees give on average if only
these features decide: at a split on another feature both children count, by
their share of the training rows (cover). A leaf then is a product over the
features on its path: the share ``z`` of rows that stay on the path at the
feature's splits, or ``o``, whether the row itself stays. The Shapley value of
the product is a weighted sum of the coefficients of the polynomial
``prod(z + o t)`` over the other features, so a leaf costs the square of its path
instead of one score for each of all 2^n subsets.

``o`` is 0 or 1 and a path has at most all features, so the values of a leaf are
a table with one row per pattern of ``o``, made once on the driver from the
node tables (trees x leaves: bounded by the model) and broadcast. A row needs one
look-up per leaf; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.sources.storage import new_path, remove, ship_package

NAMES = C.RANKING_FEATURES
#: Numbers that a block of rows takes at a time.
BLOCK = 4_000_000


@dataclass
class Split:
    """Rows with ``feature`` at most ``threshold`` go to ``left``, others to ``right``."""

    feature: int
    threshold: float
    left: Split | Leaf
    right: Split | Leaf
    cover: float = 0.0


@dataclass
class Leaf:
    value: float
    cover: float = 0.0


Tree = Split | Leaf


def trees_of(model: PipelineModel) -> list[Tree]:
    """The weighted trees of a trained ranker, read from the node tables that it is stored as."""
    fitted = model.stages[-1]
    spark = SparkSession.active()
    path = new_path(spark, "trees")
    fitted.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # bounded by the model
    remove(spark, path)
    nodes = {(r["treeID"], r["id"]): r for r in rows}

    def build(tree: int, number: int, weight: float) -> Tree:
        r = nodes[tree, number]
        if r["leftChild"] < 0:
            return Leaf(weight * r["prediction"], float(r["rawCount"]))
        split = r["split"]
        children = [build(tree, r[side], weight) for side in ("leftChild", "rightChild")]
        return Split(split["featureIndex"], split["leftCategoriesOrThreshold"][0], *children, float(r["rawCount"]))

    return [build(t, 0, w) for t, w in enumerate(fitted.treeWeights)]


def with_covers(trees: list[Tree], rows: DataFrame) -> list[Tree]:
    """The trees with their covers counted over ``rows``, in one aggregation."""
    conditions: list = []

    def visit(tree: Tree, here) -> None:
        conditions.append(here)
        if isinstance(tree, Split):
            left = F.col(NAMES[tree.feature]) <= tree.threshold
            visit(tree.left, here & left)
            visit(tree.right, here & ~left)

    for tree in trees:
        visit(tree, F.lit(True))
    counts = iter(rows.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(conditions)]).first())

    def counted(tree: Tree) -> Tree:
        n = float(next(counts))
        if isinstance(tree, Leaf):
            return Leaf(tree.value, n)
        return Split(tree.feature, tree.threshold, counted(tree.left), counted(tree.right), n)

    return [counted(t) for t in trees]


@dataclass
class Leaves:
    """All leaves: per path slot a feature and its interval, and the contributions by pattern."""

    feature: np.ndarray  # leaves x slots
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    table: np.ndarray  # (leaves * patterns) x slots
    base: float


def leaf_tables(trees: list[Tree]) -> Leaves:
    paths: list[tuple[float, dict[int, list[float]]]] = []

    def visit(tree: Tree, path: dict[int, list[float]]) -> None:
        if isinstance(tree, Leaf):
            paths.append((tree.value, path))
            return
        for child, low, high in ((tree.left, -np.inf, tree.threshold), (tree.right, tree.threshold, np.inf)):
            # A node that no row reaches keeps no share.
            share = child.cover / tree.cover if tree.cover else 0.0
            a, b, z = path.get(tree.feature, [-np.inf, np.inf, 1.0])
            visit(child, path | {tree.feature: [max(a, low), min(b, high), z * share]})

    for tree in trees:
        visit(tree, {})
    slots = max([1, *(len(p) for _, p in paths)])
    n, patterns = len(paths), 1 << slots
    feature = np.zeros((n, slots), dtype=np.int64)
    low, high, z = np.full((n, slots), -np.inf), np.full((n, slots), np.inf), np.ones((n, slots))
    for i, (_, path) in enumerate(paths):
        for k, (f, (a, b, share)) in enumerate(sorted(path.items())):
            feature[i, k], low[i, k], high[i, k], z[i, k] = f, a, b, share
    value = np.array([v for v, _ in paths])
    on = (np.arange(patterns)[:, None] >> np.arange(slots) & 1).astype(float)
    weights = [factorial(s) * factorial(slots - s - 1) / factorial(slots) for s in range(slots)]
    table = np.zeros((n, patterns, slots))
    # Unused slots stay at z = o = 1: they get nothing and change nothing for the others.
    for j in range(slots):
        poly = np.zeros((n, patterns, slots))
        poly[:, :, 0] = 1.0
        for k in range(slots):
            if k != j:
                stay, share = on[None, :, k, None], z[:, None, k, None]
                shifted = np.concatenate([np.zeros((n, patterns, 1)), poly[:, :, :-1]], axis=2)
                poly = poly * share + shifted * stay
        table[:, :, j] = value[:, None] * (on[None, :, j] - z[:, None, j]) * (poly @ np.array(weights))
    base = float((value * z.prod(axis=1)).sum())
    return Leaves(feature, low, high, value, table.reshape(n * patterns, slots), base)


def contributions_of(rows: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """Contribution of every feature, and the margin, of rows x features."""
    n, slots = leaves.feature.shape
    patterns = 1 << slots
    owned = [np.flatnonzero(leaves.feature.ravel() == f) for f in range(rows.shape[1])]
    out, margin = np.zeros(rows.shape), np.zeros(len(rows))
    step = max(1, BLOCK // (n * slots))
    for at in range(0, len(rows), step):
        x = rows[at : at + step]
        pattern = np.zeros((len(x), n), dtype=np.int64)
        for k in range(slots):
            own = x[:, leaves.feature[:, k]]
            pattern |= ((own > leaves.low[:, k]) & (own <= leaves.high[:, k])).astype(np.int64) << k
        found = leaves.table[pattern + np.arange(n) * patterns].reshape(len(x), n * slots)
        for f, places in enumerate(owned):
            out[at : at + step, f] = found[:, places].sum(axis=1)
        margin[at : at + step] = (pattern == patterns - 1) @ leaves.value
    return out, margin


def tree_attribution(features: DataFrame, trees: list[Tree], keys: list[str]) -> DataFrame:
    """``keys``, ``c_<feature>`` for every ranking feature, ``margin`` and ``base_margin`` of every row.

    The contributions and ``base_margin`` add up to ``margin``, the sum of the
    trees. A feature that is null goes to neither child of its splits.
    """
    spark = features.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(leaf_tables(trees))
    slim = features.select(*keys, *[F.col(n).cast("double").alias(n) for n in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = shared.value
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES]
            found, margin = contributions_of(np.stack(columns, axis=1).astype(float), leaves)
            arrays = [batch.column(k) for k in keys]
            arrays += [pa.array(found[:, f]) for f in range(len(NAMES))]
            arrays += [pa.array(margin), pa.array(np.full(len(margin), leaves.base))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *[f"c_{n}" for n in NAMES], "margin", "base_margin"])

    own = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    parts = ", ".join(f"c_{n} double" for n in NAMES)
    return slim.mapInArrow(run, f"{own}, {parts}, margin double, base_margin double")
