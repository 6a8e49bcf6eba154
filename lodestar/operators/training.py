"""Training examples, negatives, losses and factor models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions import hashing as H
from lodestar.functions import vectors as V
from lodestar.functions.joins import counted_join, lookup_join, spread_join
from lodestar.functions.numbering import global_row_number, hash_positions
from lodestar.operators import features
from lodestar.operators.retrieval import vector_topk
from lodestar.sources.storage import cut_lineage

# Rounds of subspace iteration, and columns carried beyond the wanted rank.
SVD_ROUNDS, SVD_EXTRA = 6, 8

# Ratings of an ALS block, which a task sorts in memory, fewest blocks, and rounds after which the shuffles of earlier ones are deleted.
BLOCK_RATINGS, FEW_BLOCKS, CHECKPOINTED = 24_000_000, 4, 2

# ---- negatives -------------------------------------------------------------------------


def dense_index(catalogue: DataFrame) -> DataFrame:
    """(item_id, idx): positions 0..N-1 in id order."""
    numbered = global_row_number(catalogue.select("item_id"), "item_id", "n")
    return numbered.select("item_id", (F.col("n") - 1).alias("idx"))


def uniform_negatives(
    positives: DataFrame,
    catalogue: DataFrame,
    ratio: int = C.NEGATIVES_PER_POSITIVE,
    seed: str = "negative",
    wanted: DataFrame | None = None,
) -> DataFrame:
    """``ratio`` catalogue items per positive, never the positive itself.

    ``positives`` holds (event_id, user_id, item_id). A draw from N-1 positions
    is shifted past the positive's own, so nothing is redrawn. ``wanted`` limits
    the draws to its (event_id, j).
    """
    index = dense_index(catalogue)
    size = catalogue.agg(F.count("*")).scalar()
    own = spread_join(positives.select("event_id", "user_id", "item_id"), index, ["item_id"], F.col("event_id"))
    sized = own.withColumn("_size", size)
    if wanted is None:
        draws = sized.withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(1, ratio + 1)])))
    else:
        draws = sized.join(wanted.select("event_id", "j"), "event_id")
    draw = H.hash_index(seed, F.col("event_id"), F.col("j"), size=F.col("_size") - 1)
    shifted = draws.withColumn("_draw", draw).select(
        "event_id",
        "user_id",
        "j",
        (F.col("_draw") + (F.col("_draw") >= F.col("idx")).cast("int")).alias("idx"),
    )
    return shifted.join(index, "idx").select("event_id", "user_id", "j", "item_id")


def shown_not_clicked(impressions: DataFrame) -> DataFrame:
    """(user_id, day, item_id) shown without a click.

    Impressions hold one row per (user, day, item) with its click flag, so the
    difference of the two sets is a filter.
    """
    return impressions.filter("clicked = 0").select("user_id", "day", "item_id")


def shown_negatives(
    positives: DataFrame,
    impressions: DataFrame,
    catalogue: DataFrame,
    ratio: int = C.NEGATIVES_PER_POSITIVE,
    seed: str = "shown",
) -> DataFrame:
    """Negatives from what the user saw that day and did not click.

    The pool of a (user, day) gets hash-ordered positions once; a positive
    takes consecutive positions from a hashed start, by equi-join, so pools and
    positives are never paired in full. Pools smaller than ``ratio`` are
    completed with uniform negatives.
    """
    pool = cut_lineage(shown_not_clicked(impressions))
    u = H.hash_uniform(seed, F.col("user_id"), F.col("day"), F.col("item_id"))
    placed = hash_positions(pool, ["user_id", "day"], u, ["item_id"], "position")
    sizes = pool.groupBy("user_id", "day").agg(F.count("*").alias("size"))
    own = positives.select("event_id", "user_id", "day")
    sized = own.join(sizes, ["user_id", "day"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    wanted = sized.withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(1, ratio + 1)])))
    start = H.hash_index(seed, F.lit("start"), F.col("event_id"), size=F.col("size"))
    inside = wanted.filter(F.col("j") <= F.col("size")).withColumn(
        "position", F.pmod(start + F.col("j") - 1, F.col("size")) + 1
    )
    seen = inside.join(placed, ["user_id", "day", "position"]).select(
        "event_id", "user_id", "j", "item_id", F.lit("shown").alias("source")
    )
    missing = wanted.filter(F.col("j") > F.col("size")).select("event_id", "j")
    uniform = uniform_negatives(positives, catalogue, ratio, wanted=missing)
    filled = uniform.select("event_id", "user_id", "j", "item_id", F.lit("uniform").alias("source"))
    return seen.unionByName(filled)


def training_examples(
    positives: DataFrame, negatives: DataFrame, items: DataFrame, interactions: DataFrame
) -> DataFrame:
    """Positive (j = 0) and negative rows with item attributes and user context as of the event.

    ``positives`` holds (event_id, user_id, item_id, device, created_at) of
    events in ``interactions``. The sequence ends before the event, click rates
    count the days before it.
    """
    rows = positives.select("event_id", "user_id", F.lit(0).alias("j"), "item_id").unionByName(
        negatives.select("event_id", "user_id", "j", "item_id")
    )
    rows = cut_lineage(rows)
    context = positives.select(
        "event_id",
        "created_at",
        F.to_date("created_at").alias("day"),
        E.list_index(F.col("device"), C.DEVICES).alias("device_id"),
        F.hour("created_at").alias("time_of_day"),
    ).join(features.sequences_before(interactions), "event_id")
    attributes = items.select(
        "item_id",
        E.list_index(F.col("category"), C.CATEGORIES).alias("category_id"),
        F.col("created_at").alias("published_at"),
    )
    # Examples of an event stay together; busy items are dealt over several tasks.
    described = lookup_join(rows.join(context, "event_id"), attributes, ["item_id"], F.struct("event_id", "j"))
    days = positives.select("event_id", F.to_date("created_at").alias("day"))
    rates = cut_lineage(features.ctr_before(interactions, rows.join(days, "event_id")))
    rated = counted_join(described, rates, ["item_id", "day"], F.struct("event_id", "j"), "n")
    return rated.select(
        "event_id",
        "j",
        "user_id",
        "item_id",
        (F.col("j") == 0).cast("int").alias("label"),
        "category_id",
        E.freshness(F.col("published_at"), F.col("created_at")).alias("freshness_score"),
        F.coalesce("ctr", F.lit(0.0)).alias("historical_ctr"),
        "device_id",
        "time_of_day",
        features.pad_sequence(F.col("sequence")).alias("recent_item_sequence"),
    )


def train_val_split(
    rows: DataFrame, key: str, fraction: float = C.VALIDATION_FRACTION, seed: str = "split"
) -> DataFrame:
    """Add ``is_validation``: a stable share of rows, and never none of them."""
    u = H.hash_uniform(seed, F.col(key))
    smallest = rows.agg(F.min(u)).scalar()
    return rows.withColumn("is_validation", (u < fraction) | (u == smallest))


# ---- sampled softmax ------------------------------------------------------------------------


def _logits(
    positives: DataFrame, negatives: DataFrame, users: DataFrame, items: DataFrame
) -> DataFrame:
    """(event_id, user_id, rows): candidate items of each example with their logits."""
    rows = positives.select("event_id", "user_id", F.lit(0).alias("j"), "item_id").unionByName(
        negatives.select("event_id", "user_id", "j", "item_id")
    )
    user_vectors = users.select("user_id", F.col("embedding").alias("u"))
    item_vectors = items.select("item_id", F.col("embedding").alias("v"))
    logit = V.dot(F.col("u"), F.col("v")).alias("logit")
    scored = (
        rows.join(item_vectors, "item_id")
        .join(user_vectors, "user_id")
        .select("event_id", "user_id", F.struct("j", "item_id", logit).alias("row"))
    )
    # One positive and a few negatives per example.
    return scored.groupBy("event_id", "user_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def _log_sum_exp() -> Column:
    top = F.array_max("rows.logit")
    shifted = F.aggregate("rows", F.lit(0.0), lambda acc, r: acc + F.exp(r["logit"] - top))
    return top + F.ln(shifted)


def sampled_softmax_loss(
    positives: DataFrame, negatives: DataFrame, users: DataFrame, items: DataFrame
) -> DataFrame:
    """Mean cross-entropy of the positive against itself and its negatives."""
    examples = _logits(positives, negatives, users, items)
    loss = _log_sum_exp() - F.element_at("rows.logit", 1)
    return examples.agg(F.count("*").alias("examples"), F.avg(loss).alias("loss"))


def online_vector_update(
    positives: DataFrame,
    negatives: DataFrame,
    users: DataFrame,
    items: DataFrame,
    dim: int,
    learning_rate: float = C.ONLINE_LEARNING_RATE,
) -> DataFrame:
    """One gradient step of the sampled-softmax loss on the users' vectors.

    Coefficients are summed per (user, item) before item vectors are joined.
    """
    examples = _logits(positives, negatives, users, items).withColumn("lse", _log_sum_exp())
    share = F.exp(F.col("row.logit") - F.col("lse"))
    coefficient = share - (F.col("row.j") == 0).cast("double")
    per_item = (
        examples.select("user_id", "lse", F.explode("rows").alias("row"))
        .select("user_id", "row.item_id", "row.j", coefficient.alias("c"))
        .groupBy("user_id", "item_id")
        .agg(F.sum("c").alias("c"), F.sum((F.col("j") == 0).cast("int")).alias("n"))
    )
    item_vectors = items.select("item_id", "embedding")
    gradients = (
        per_item.join(item_vectors, "item_id")
        .groupBy("user_id")
        .agg(V.vector_sum("embedding", dim, "c").alias("g"), F.sum("n").alias("n"))
    )
    rate = F.lit(learning_rate) / F.col("n")
    stepped = F.zip_with(V.as_double(F.col("embedding")), "g", lambda x, g: x - rate * g)
    return users.join(gradients, "user_id").select("user_id", stepped.alias("embedding"))


# ---- factor models --------------------------------------------------------------------------


def click_counts(interactions: DataFrame) -> DataFrame:
    """(user_id, item_id, n) of positive events."""
    positive = interactions.filter(E.signal_weight(F.col("event_type")) > 0)
    return positive.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))


def cf_svd(
    pairs: DataFrame, k: int = C.CF_FACTORS, rounds: int = SVD_ROUNDS, seed: str = "svd"
) -> tuple[DataFrame, DataFrame]:
    """Truncated SVD of the binary (user, item) matrix: (user factors U*S, item factors V).

    Subspace iteration on the pairs: item vectors are multiplied by the matrix
    and its transpose by joins and sums, then made orthonormal by their Gram
    matrix. Only width x width matrices reach the driver, whatever the number
    of users and items.
    """
    width = k + SVD_EXTRA
    pairs = cut_lineage(pairs.select("user_id", "item_id").distinct())
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda j: H.hash_uniform(seed, F.col("item_id"), j) - 0.5
    )
    items = pairs.select("item_id").distinct().withColumn("v", draws)
    for _ in range(rounds):
        users = _gather(items, pairs, "item_id", "user_id", width)
        items = _orthonormal(cut_lineage(_gather(users, pairs, "user_id", "item_id", width)), width)
    users = cut_lineage(_gather(items, pairs, "item_id", "user_id", width))
    # The rotation that orders the subspace by singular values.
    values, rotation = np.linalg.eigh(gram(users, width))
    rotation = rotation[:, np.argsort(values)[::-1][:k]]
    return (
        _times(users, rotation).select("user_id", F.col("v").alias("embedding")),
        _times(items, rotation).select("item_id", F.col("v").alias("embedding")),
    )


def _gather(vectors: DataFrame, pairs: DataFrame, at: str, to: str, width: int) -> DataFrame:
    """Sum of the vectors that each ``to`` is paired with (Spark splits the join at busy keys)."""
    return pairs.join(vectors, at).groupBy(to).agg(V.vector_sum("v", width).alias("v"))


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """width x width matrix of the products of the columns, summed within the tasks first."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                matrix = np.stack(frame["v"].to_numpy())
                total += matrix.T @ matrix
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    rows = vectors.select("v").mapInPandas(partial, "i int, row array<double>")
    summed = rows.groupBy("i").agg(V.vector_sum("row", width).alias("row")).collect()
    out = np.zeros((width, width))
    for r in summed:
        out[r["i"]] = r["row"]
    return out


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""

    @F.pandas_udf("array<double>")
    def product(column: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(column.to_numpy()) @ matrix)) if len(column) else column

    return vectors.withColumn("v", product("v"))


def _orthonormal(vectors: DataFrame, width: int) -> DataFrame:
    """Columns made orthonormal over all rows; directions without weight become zero."""
    values, directions = np.linalg.eigh(gram(vectors, width))
    keep = values > max(values.max(), 0) * 1e-12
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)
    return _times(vectors, directions * scale)


def cf_als(
    pairs: DataFrame, rank: int = C.CF_FACTORS, reg: float = 0.05, iterations: int = 10, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Implicit-feedback ALS: (user factors, item factors). Ids of any size are indexed densely first."""
    users = cut_lineage(_dense(pairs, "user_id"))
    items = cut_lineage(_dense(pairs, "item_id"))
    als = ALS(
        rank=rank,
        maxIter=iterations,
        regParam=reg,
        implicitPrefs=True,
        userCol="user",
        itemCol="item",
        ratingCol="n",
        seed=seed,
        checkpointInterval=CHECKPOINTED,
    )
    # Merged: copies of stored ids look small to the planner, which would send them whole through the driver.
    ratings = cut_lineage(_ratings(pairs, users.hint("merge"), items.hint("merge")))
    model = als.copy(_blocks(als, ratings)).fit(ratings)
    named = [
        factors.withColumn("id", F.col("id").cast("bigint")).join(ids, "id").select(key, F.col("features").alias("embedding"))
        for factors, ids, key in (
            (model.userFactors, users.withColumnRenamed("user", "id"), "user_id"),
            (model.itemFactors, items.withColumnRenamed("item", "id"), "item_id"),
        )
    ]
    return named[0], named[1]


def _dense(pairs: DataFrame, key: str) -> DataFrame:
    """Distinct ids with their positions 0..N-1."""
    numbered = global_row_number(pairs.select(key).distinct(), key, "_n")
    return numbered.select(key, (F.col("_n") - 1).alias(key.removesuffix("_id")))


def _ratings(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    indexed = spread_join(pairs, users, ["user_id"], F.col("item_id"))
    indexed = spread_join(indexed, items, ["item_id"], F.col("user_id"))
    return indexed.select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("n").cast("float"))


def _blocks(als: ALS, ratings: DataFrame) -> dict:
    """ALS blocks for a stored table of ratings: one per BLOCK_RATINGS, a few at least.

    Every round sends the vector of a user to all blocks that hold one of their items, and the reverse,
    so what is shuffled grows with the number of blocks; the memory of a task grows with their size.
    """
    n = max(FEW_BLOCKS, -(-ratings.count() // BLOCK_RATINGS))
    return {als.numUserBlocks: n, als.numItemBlocks: n}


def recommend_from_factors(
    users: DataFrame, items: DataFrame, n: int, exclude: DataFrame | None = None
) -> DataFrame:
    """Top-n by factor product, without the excluded (user, item) pairs."""
    if exclude is None:
        return vector_topk(users, items, n, unit=False)
    # Distinct items per user: at most one catalogue's worth of ids.
    lists = exclude.groupBy("user_id").agg(F.collect_set("item_id").alias("skip"))
    return vector_topk(users.join(lists, "user_id", "left"), items, n, unit=False, skip="skip")


def tune_factorization(
    pairs: DataFrame, ranks: list[int], regs: list[float], seed: int = 7, iterations: int = 10
) -> DataFrame:
    """Validation RMSE of each (rank, reg) of an explicit ALS on the counts."""
    als = ALS(
        userCol="user",
        itemCol="item",
        ratingCol="n",
        coldStartStrategy="drop",
        maxIter=iterations,
        seed=seed,
        checkpointInterval=CHECKPOINTED,
    )
    ratings = cut_lineage(_ratings(pairs, _dense(pairs, "user_id"), _dense(pairs, "item_id")))
    als = als.copy(_blocks(als, ratings))
    # Blocks for all cores are one model's work at a time, and lie on disk: a task holds its own only.
    large = als.getNumUserBlocks() >= ratings.sparkSession.sparkContext.defaultParallelism
    if large:
        als.setIntermediateStorageLevel("DISK_ONLY")
    grid = ParamGridBuilder().addGrid(als.rank, ranks).addGrid(als.regParam, regs).build()
    search = TrainValidationSplit(
        estimator=als,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol="n", predictionCol="prediction", metricName="rmse"),
        trainRatio=1.0 - C.VALIDATION_FRACTION,
        parallelism=1 if large else 2,
        seed=seed,
    )
    found = search.fit(ratings)
    rows = [
        (p[als.rank], p[als.regParam], float(m)) for p, m in zip(grid, found.validationMetrics)
    ]
    return pairs.sparkSession.createDataFrame(rows, "rank int, reg double, rmse double")


# ---- gradient-boosted ranker -------------------------------------------------------------------


def train_ranker(
    examples: DataFrame,
    rounds: int = 200,
    depth: int = 5,
    step: float = 0.05,
    seed: int = 7,
) -> PipelineModel:
    """Boosted trees on the seven ranking features; ``label`` is 0/1."""
    assembler = VectorAssembler(inputCols=C.RANKING_FEATURES, outputCol="features")
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed
    )
    return Pipeline(stages=[assembler, trees]).fit(examples)


def save_ranker(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_ranker(path: str) -> PipelineModel:
    return PipelineModel.load(path)
