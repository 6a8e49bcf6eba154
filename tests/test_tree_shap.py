"""Shapley values of trees against all subsets."""

from itertools import combinations
from math import factorial

import numpy as np

from lodestar import constants as C
from lodestar.operators import training, tree_shap
from lodestar.operators.tree_shap import Leaf, Split

N = len(C.RANKING_FEATURES)


def expected(tree, row, subset):
    """What a tree gives on average when only the features of ``subset`` decide."""
    if isinstance(tree, Leaf):
        return tree.value
    if tree.feature in subset:
        return expected(tree.left if row[tree.feature] <= tree.threshold else tree.right, row, subset)
    sides = [(c.cover / tree.cover if tree.cover else 0.0) * expected(c, row, subset) for c in (tree.left, tree.right)]
    return sum(sides)


def by_subsets(trees, row):
    def worth(subset):
        return sum(expected(t, row, set(subset)) for t in trees)

    out = []
    for j in range(N):
        others = [k for k in range(N) if k != j]
        total = 0.0
        for size in range(N):
            weight = factorial(size) * factorial(N - size - 1) / factorial(N)
            total += weight * sum(worth((*s, j)) - worth(s) for s in combinations(others, size))
        out.append(total)
    return out, worth(()), worth(range(N))


def random_tree(rng, depth, cover=1000.0):
    if depth == 0 or rng.random() < 0.15:
        return Leaf(float(rng.normal()), cover)
    left = float(rng.integers(0, int(cover) + 1))
    return Split(
        int(rng.integers(0, N)), float(rng.random()), random_tree(rng, depth - 1, left), random_tree(rng, depth - 1, cover - left), cover
    )


def test_equal_to_all_subsets():
    rng = np.random.default_rng(1)
    for depth in (0, 1, 3, 5, 8):
        trees = [random_tree(rng, depth) for _ in range(3)]
        rows = rng.random((4, N))
        found, margin = tree_shap.contributions_of(rows, tree_shap.leaf_tables(trees))
        for row, own, total in zip(rows, found, margin):
            want, base, full = by_subsets(trees, row)
            assert np.allclose(own, want, atol=1e-9)
            assert abs(total - full) < 1e-9 and abs(base + own.sum() - full) < 1e-9


def test_trained_ranker(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.random(N))) for i in range(400)]
    columns = ["k", *C.RANKING_FEATURES]
    examples = spark.createDataFrame(rows, columns)
    examples = examples.selectExpr("*", "CAST(popularity_score + 0.3 * time_decay > 0.6 AS INT) AS label")
    model = training.train_ranker(examples, rounds=4, depth=3)
    trees = tree_shap.trees_of(model)
    found = {r.k: r for r in tree_shap.tree_attribution(examples, trees, ["k"]).collect()}
    raw = {r.k: float(r.rawPrediction[1]) for r in model.transform(examples).collect()}
    for i, *row in rows[:20]:
        want, base, _ = by_subsets(trees, row)
        r = found[i]
        assert np.allclose([r[f"c_{n}"] for n in C.RANKING_FEATURES], want, atol=1e-9)
        assert abs(r.base_margin - base) < 1e-9
    for i, r in found.items():
        total = r.base_margin + sum(r[f"c_{n}"] for n in C.RANKING_FEATURES)
        # The classifier's raw score of the positive class is the sum of its trees.
        assert abs(total - r.margin) < 1e-9 and abs(abs(raw[i]) - abs(r.margin)) < 1e-9
    assert abs(sum(abs(r.c_diversity_score) for r in found.values())) < sum(abs(r.c_popularity_score) for r in found.values())


def test_covers_are_counts(spark):
    tree = Split(0, 0.5, Leaf(1.0), Split(1, 0.2, Leaf(2.0), Leaf(3.0)))
    rows = spark.createDataFrame([(0.1, 0.1), (0.6, 0.2), (0.9, 0.5), (0.7, 0.9)], C.RANKING_FEATURES[:2])
    (found,) = tree_shap.with_covers([tree], rows)
    assert (found.cover, found.left.cover, found.right.cover) == (4, 1, 3)
    assert (found.right.left.cover, found.right.right.cover) == (1, 2)
