"""Scoring, re-ranking, diversity, exploration slots and feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions import hashing as H
from lodestar.functions.joins import lookup_join
from lodestar.functions.numbering import global_row_number
from lodestar.functions.rounding import round_double
from lodestar.operators.retrieval import item_matrix
from lodestar.sources.storage import cut_lineage

# Weights of the plain linear scorer, in the order of RANKING_FEATURES.
LINEAR_WEIGHTS = [0.4, 0.1, 0.2, 0.05, 0.05, 0.1, 0.1]
# Users of a group that meets all item vectors in one task; groups per core, at least.
GROUP_USERS, GROUPS = 8192, 3
# What an item of the catalogue takes as a look-up: category, times and a few numbers; and all items of one that is sent to the
# tasks. Candidates are a thousand a user: beyond it they are all shuffled by item, and by user again.
CATALOGUE_BYTES, CATALOGUE_MOST = 128, 128 << 20


def by_score(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), "item_id")


# ---- features and scores ---------------------------------------------------------


def ranking_features(
    candidates: DataFrame,
    items: DataFrame,
    affinity: DataFrame,
    ctr: DataFrame,
    popularity: DataFrame,
    now: Column,
) -> DataFrame:
    """The seven ranking features per (user, item); missing values are 0.0."""
    catalogue = (
        items.select("item_id", "category", "created_at")
        .join(ctr.select("item_id", "ctr"), "item_id", "left")
        .join(popularity.select("item_id", "popularity"), "item_id", "left")
    )
    # Injected items are candidates of every user.
    described = lookup_join(candidates, catalogue, ["item_id"], F.col("user_id"), "left", CATALOGUE_BYTES, CATALOGUE_MOST, items)
    # A user's few categories travel as one map, so that rows stay dealt by user; hashed, they need no sorted candidates.
    entries = F.map_from_entries(F.collect_list(F.struct("category", "affinity"))).alias("_affinity")
    by_user = affinity.filter(F.col("category").isNotNull()).groupBy("user_id").agg(entries).hint("shuffle_hash")
    own = F.element_at("_affinity", F.col("category"))
    joined = described.join(by_user, "user_id", "left")
    values = [
        F.col("score"),
        E.freshness(F.col("created_at"), now),
        own,
        F.lit(1.0) - F.hour(now) / 24.0,
        F.lit(1.0) - F.coalesce(own, F.lit(0.0)),
        F.col("ctr"),
        F.col("popularity"),
    ]
    named = [F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, C.RANKING_FEATURES)]
    extra = [c for c in candidates.columns if c not in ("user_id", "item_id", "score")]
    return joined.select("user_id", "item_id", *extra, "category", "created_at", *named)


def linear_score(weights: list[float] | None = None) -> Column:
    terms = zip(weights or LINEAR_WEIGHTS, C.RANKING_FEATURES)
    total = F.lit(0.0)
    for weight, name in terms:
        total = total + F.lit(weight) * F.col(name)
    return total


def ranker_scores(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Add ``score`` in [0, 1] from a trained ranker."""
    predicted = model.transform(features)
    score = vector_to_array("probability")[1]
    return predicted.withColumn("score", score).drop("features", "rawPrediction", "probability", "prediction")


def with_score(features: DataFrame, score: Column | PipelineModel | None = None) -> DataFrame:
    """Add ``score`` by an expression over the features (linear by default) or a trained ranker."""
    if isinstance(score, PipelineModel):
        scored = ranker_scores(score, features.drop("score"))
    else:
        scored = features.withColumn("score", linear_score() if score is None else score)
    rounding = round_double if scored.schema["score"].dataType.simpleString() == "double" else F.round
    return scored.withColumn("score", rounding("score", 6))


def score_candidates(features: DataFrame, score: Column | PipelineModel | None = None) -> DataFrame:
    """Rank candidates of each user by ``with_score``."""
    return with_score(features, score).withColumn("rank", F.row_number().over(by_score("user_id")))


def pluggable_score(
    features: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], names: list[str] | None = None
) -> DataFrame:
    """Add ``score`` from any function of the feature matrix (rows x features)."""
    names = names or C.RANKING_FEATURES
    schema = features.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns that the scorer doesn't ask for pass through as they are.
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
            scores = np.asarray(scorer(np.stack(columns).T), dtype=float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return features.mapInArrow(run, schema)


# ---- adjustments -------------------------------------------------------------------


def seen_flags(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Mark candidates found among the (user, item) pairs already seen.

    A user's seen items (a bounded list of recent ones) travel as one array, so candidates dealt by user stay where they are.
    """
    return _with_items_of(candidates, seen).withColumn("seen", _among_items()).drop("_items")


def _with_items_of(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    listed = pairs.groupBy("user_id").agg(F.collect_set("item_id").alias("_items"))
    # The lists are hashed, so that the candidates need no order.
    return candidates.join(listed.hint("shuffle_hash"), "user_id", "left")


def _among_items() -> Column:
    return F.coalesce(F.array_contains("_items", F.col("item_id")), F.lit(False))


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    pairs = seen.select("user_id", "item_id").distinct()
    return candidates.join(pairs, ["user_id", "item_id"], "left_anti")


def candidate_attributes(candidates: DataFrame, items: DataFrame) -> DataFrame:
    return candidates.join(items.select("item_id", "category", "created_at", "embedding"), "item_id", "left")


def adjusted_score(candidates: DataFrame, now: Column) -> DataFrame:
    """Halve seen items, raise items at most a day old; needs ``seen`` and ``created_at``."""
    age = E.seconds_between(now, F.col("created_at")) / 3600.0
    fresh = F.coalesce(age <= C.NEW_ITEM_HOURS, F.lit(False))
    score = F.col("score") * F.when(F.col("seen"), C.SEEN_PENALTY).otherwise(1.0)
    boosted = F.when(fresh, score * C.FRESHNESS_BOOST).otherwise(score)
    adjusted = candidates.withColumns({"score": boosted.cast("double"), "freshness_boosted": fresh})
    return adjusted.withColumn("score", round_double("score", 9))


def rerank_adjust(candidates: DataFrame, now: Column) -> DataFrame:
    """Adjusted scores and the new order."""
    adjusted = adjusted_score(candidates, now)
    return adjusted.withColumn("rank", F.row_number().over(by_score("user_id")))


def _mmr_picks(ids, relevance, has_vector, matrix, n: int, weight: float) -> np.ndarray:
    """Positions of the first n items: greedy picks, then items without a vector.

    Ties go to the lower id.
    """
    order = np.argsort(ids, kind="stable")
    known, unknown = order[has_vector[order]], order[~has_vector[order]]
    rows = np.cumsum(has_vector) - 1
    unit = matrix[rows[known]] if len(known) else matrix
    unit = unit / (np.linalg.norm(unit, axis=1, keepdims=True) + 1e-9)
    rel = relevance[known]
    free = np.ones(len(known), dtype=bool)
    nearest = None
    picks = []
    for _ in range(min(n, len(known))):
        gain = rel if nearest is None else np.round(weight * rel - (1 - weight) * nearest, 9)
        best = int(np.argmax(np.where(free, gain, -np.inf)))
        picks.append(known[best])
        free[best] = False
        similarity = np.round(unit @ unit[best], 6)
        nearest = similarity if nearest is None else np.maximum(nearest, similarity)
    tail = unknown[np.argsort(-relevance[unknown], kind="stable")]
    return np.array([*picks, *tail], dtype=np.int32)[:n]


def _picks_by_id(ids, relevance, known, vectors, n: int, weight: float) -> np.ndarray:
    """The same, with vectors, as stored, looked up by id among the sorted ``known``."""
    at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
    has = known[at] == ids if len(known) else np.zeros(len(ids), dtype=bool)
    return _mmr_picks(ids, relevance, has, vectors[at[has]].astype(float), n, weight)


def mmr_positions_by_id(shared: Broadcast, n: int) -> Callable[..., Column]:
    """Arrow UDF over one packed row per user, with the vectors in a broadcast (sorted ids, vectors).

    (ids, scores, weight of relevance) -> 0-based positions of the n chosen items, in order.
    """

    @F.pandas_udf("array<int>")
    def positions(ids: pd.Series, scores: pd.Series, weights: pd.Series) -> pd.Series:
        known, vectors = shared.value
        picked = []
        for id_list, rel, weight in zip(ids, scores, weights):
            picked.append(_picks_by_id(np.asarray(id_list, dtype=np.int64), np.asarray(rel), known, vectors, n, weight))
        return pd.Series(picked)

    return positions


def pack_lists(ranked: DataFrame, columns: list[str], weight: Column) -> DataFrame:
    """One row per user: ``c`` (structs of the columns) and ``weight``, without vectors."""
    return ranked.groupBy("user_id").agg(
        F.collect_list(F.struct(*columns)).alias("c"), F.first(weight, ignorenulls=True).alias("weight")
    )


def pack_candidates(ranked: DataFrame, weight: Column | float = C.MMR_LAMBDA) -> DataFrame:
    """Candidates (user_id, item_id, score) as one row per user, to be stored where several steps read them.

    ``mmr_pick`` and ``exploration_pool`` take them in place of rows, so that these aren't dealt by user again.
    """
    return pack_lists(ranked, ["item_id", "score"], _weight(weight))


def _weight(weight: Column | float) -> Column:
    return (weight if isinstance(weight, Column) else F.lit(weight)).cast("double")


def _picks_of_groups(packed: DataFrame, items: DataFrame, n: int, users: int) -> DataFrame:
    """Add ``picked`` to packed rows against item vectors of any size.

    All vectors are sent once to each group of users, in which they are looked up; so what is shuffled
    are the packed rows once and the vectors once per group, never a vector per candidate.
    """
    spark = packed.sparkSession
    cores = spark.sparkContext.defaultParallelism
    groups = max(GROUPS * cores, -(-users // GROUP_USERS))
    known = items.filter(F.col("embedding").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("id"), F.col("embedding").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    )
    asked = packed.withColumn("group", F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int"))
    both = asked.withColumn("is_user", F.lit(True)).unionByName(known.withColumn("is_user", F.lit(False)), allowMissingColumns=True)
    sent = both.repartitionById(groups, "group").sortWithinPartitions("group", "is_user", "id")
    schema = packed.withColumn("picked", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, parts, vectors = None, [], [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for own in pc.unique(batch.column("group")).to_pylist():
                of_group = table.filter(pc.equal(table["group"], own))
                if own != group:
                    group, ids, parts, vectors = own, [], [], None
                found = of_group.filter(pc.invert(of_group["is_user"])).combine_chunks()
                if len(found):
                    ids.append(found["id"].to_numpy())
                    parts.append(found["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1))
                rows = of_group.filter(of_group["is_user"]).combine_chunks()
                if not len(rows):
                    continue
                if vectors is None:
                    known_ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
                    vectors = np.concatenate(parts) if parts else np.zeros((0, 1))
                    parts = []
                picked = []
                for c, weight in zip(rows["c"], rows["weight"].to_pylist()):
                    item_ids, scores = (c.values.field(name).to_numpy(zero_copy_only=False) for name in ("item_id", "score"))
                    picked.append(_picks_by_id(item_ids.astype(np.int64), scores.astype(float), known_ids, vectors, n, weight))
                chosen = rows.select(schema.names[:-1]).append_column("picked", pa.array(picked, pa.list_(pa.int32())))
                yield from chosen.to_batches()

    return sent.mapInArrow(run, schema)


def mmr_pick(
    ranked: DataFrame, items: DataFrame, columns: list[str], n: int, weight: Column | float = C.MMR_LAMBDA
) -> DataFrame:
    """(user_id, c, picked): packed candidates and positions of the first n by marginal relevance.

    Candidates that are packed already (``pack_candidates``) keep their columns and their weight.

    ``weight`` balances relevance against diversity; a column gives every user
    their own (the same on all rows of a user).

    Vectors whose counted size allows are broadcast once; else they are sent to groups of
    users. Candidate rows travel without them.
    """
    packed = ranked if "c" in ranked.columns else pack_lists(ranked, columns, _weight(weight))
    shared = item_matrix(items)
    if shared is not None:
        picked = packed.withColumn("picked", mmr_positions_by_id(shared, n)("c.item_id", "c.score", "weight"))
    else:
        packed = cut_lineage(packed)
        picked = _picks_of_groups(packed, items, n, packed.count())
    return picked.select("user_id", "c", "picked")


def mmr_rerank(
    ranked: DataFrame, items: DataFrame, n: int, weight: Column | float = C.MMR_LAMBDA
) -> DataFrame:
    """First n items per user by maximal marginal relevance.

    ``ranked`` holds (user_id, item_id, score), ``items`` the vectors. Users are
    batched through Arrow, a whole candidate list at a time.
    """
    chosen = mmr_pick(ranked, items, ["item_id", "score"], n, weight)
    # The outer form keeps the optimizer from evaluating the UDF twice, once
    # for an inferred "not empty" filter.
    return chosen.select(
        "user_id", "c", F.posexplode_outer("picked").alias("pos", "at")
    ).select(
        "user_id",
        F.element_at("c.item_id", F.col("at") + 1).alias("item_id"),
        (F.col("pos") + 1).alias("rank"),
    )


def category_cap(ranked: DataFrame, fraction: float = C.CATEGORY_FRACTION) -> DataFrame:
    """Move items beyond a category's share to the end of the list, order kept."""
    per_user = Window.partitionBy("user_id")
    category = F.coalesce("category", F.lit("unknown"))
    allowed = F.greatest(F.lit(1), F.floor(F.count("*").over(per_user) * fraction))
    nth = F.row_number().over(Window.partitionBy("user_id", category).orderBy("rank"))
    marked = ranked.withColumn("overflow", nth > allowed)
    order = per_user.orderBy("overflow", "rank")
    return marked.withColumn("rank", F.row_number().over(order))


# ---- exploration slots ---------------------------------------------------------------


def arm_stats(interactions: DataFrame) -> DataFrame:
    """Pulls, total and mean reward per item; the reward is the signal weight."""
    weight = E.signal_weight(F.col("event_type"))
    return interactions.groupBy("item_id").agg(
        F.count("*").alias("pulls"),
        F.sum(weight).alias("total_reward"),
        F.avg(weight).alias("mean_reward"),
    )


def exploration_pool(candidates: DataFrame, feed: DataFrame) -> DataFrame:
    """Candidates, rows or packed, that the user's feed, a short list, doesn't hold."""
    if "c" in candidates.columns:
        # Lists are dealt by user whole, without scores that nobody asks for, and become rows where they are.
        lists = _with_items_of(candidates.select("user_id", F.col("c.item_id").alias("_ids"), F.col("c.score").alias("_scores")), feed)
        rows = lists.select("user_id", "_items", "_scores", F.posexplode_outer("_ids").alias("_at", "item_id")).filter(~_among_items())
        return rows.select("user_id", "item_id", F.get("_scores", F.col("_at")).alias("score"))
    return _with_items_of(candidates, feed).filter(~_among_items()).drop("_items")


def _with_rewards(pool: DataFrame, arms: DataFrame) -> DataFrame:
    """Pool rows with the rounded mean reward of their item, left where they are if the arms are few."""
    known = cut_lineage(arms.select("item_id", F.round("mean_reward", 6).alias("mean_reward")))
    return lookup_join(pool.select("user_id", "item_id"), known, ["item_id"], F.col("user_id"), "left", row_bytes=64)


def bandit_select(
    pool: DataFrame, arms: DataFrame, epsilon: float = C.BANDIT_EPSILON, seed: str = "bandit"
) -> DataFrame:
    """One pick per user: explore with probability epsilon, else the best known arm.

    Without a known arm in the pool the choice is uniform as well.
    """
    u = H.hash_uniform(seed, F.col("user_id"), F.col("item_id"))
    joined = _with_rewards(pool, arms)
    choice = joined.groupBy("user_id").agg(
        F.min_by("item_id", F.struct(u, "item_id")).alias("random_item"),
        F.min_by(
            "item_id",
            F.when(F.col("mean_reward").isNotNull(), F.struct(-F.col("mean_reward"), "item_id")),
        ).alias("best_item"),
    )
    explore = H.hash_uniform(seed, F.lit("draw"), F.col("user_id")) < epsilon
    return choice.select(
        "user_id",
        F.when(explore | F.col("best_item").isNull(), F.col("random_item"))
        .otherwise(F.col("best_item"))
        .alias("item_id"),
        (explore | F.col("best_item").isNull()).alias("explored"),
    )


def bandit_picks(
    pool: DataFrame,
    arms: DataFrame,
    slots: int,
    epsilon: float = C.BANDIT_EPSILON,
    seed: str = "bandit",
) -> DataFrame:
    """Up to ``slots`` distinct picks per user, slot 1 first.

    Slot j explores with probability epsilon; explored slots take the pool in
    hash order, the others the best arms in order, skipping what explored
    slots have taken. ``slots`` is a small share of a feed.
    """
    u = H.hash_uniform(seed, F.col("user_id"), F.col("item_id"))
    joined = _with_rewards(pool, arms)
    random_order = Window.partitionBy("user_id").orderBy(u, "item_id")
    best_order = Window.partitionBy("user_id").orderBy(
        F.desc_nulls_last("mean_reward"), F.when(F.col("mean_reward").isNull(), u), "item_id"
    )
    randoms = joined.withColumn("n", F.row_number().over(random_order)).filter(F.col("n") <= slots)
    best = joined.withColumn("n", F.row_number().over(best_order)).filter(F.col("n") <= 2 * slots)
    lists = (
        randoms.select("user_id", "item_id", "n", F.lit(True).alias("is_random"))
        .unionByName(best.select("user_id", "item_id", "n", F.lit(False).alias("is_random")))
        .groupBy("user_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("is_random"), F.struct("n", "item_id")))).alias("r"),
            F.array_sort(F.collect_list(F.when(~F.col("is_random"), F.struct("n", "item_id")))).alias("b"),
        )
    )
    listed = lists.select("user_id", F.col("r.item_id").alias("randoms"), F.col("b.item_id").alias("bests"))
    return (
        slot_picks(listed, slots, epsilon, seed)
        .select("user_id", F.posexplode_outer("picks").alias("pos", "item_id"))
        .filter(F.col("item_id").isNotNull())
        .select("user_id", (F.col("pos") + 1).alias("slot"), "item_id")
    )


def slot_picks(listed: DataFrame, slots: int, epsilon: float, seed: str) -> DataFrame:
    """Add ``picks`` from per-user arrays ``randoms`` and ``bests``."""
    draws = F.array(
        *[H.hash_uniform(seed, F.lit("slot"), F.col("user_id"), F.lit(j)) < epsilon for j in range(slots)]
    )
    explored = F.size(F.filter(draws, lambda d: d))
    others = F.filter("bests", lambda x: ~F.array_contains("_taken", x))
    return (
        listed.withColumn("_taken", F.slice("randoms", F.lit(1), explored))
        .withColumn("_best", F.slice(others, F.lit(1), F.lit(slots) - F.size("_taken")))
        .withColumn("picks", F.slice(F.concat("_best", "_taken"), 1, slots))
        .drop("_taken", "_best")
    )


def bandit_inject(
    feed: DataFrame,
    pool: DataFrame,
    arms: DataFrame,
    feed_size: int = C.FEED_SIZE,
    epsilon: float = C.BANDIT_EPSILON,
) -> DataFrame:
    """Replace the lowest ``max(1, int(len * epsilon))`` slots by distinct picks."""
    slots = max(1, int(feed_size * epsilon))
    picks = bandit_picks(exploration_pool(pool, feed), arms, slots, epsilon)
    length = F.count("*").over(Window.partitionBy("user_id"))
    n_slots = F.greatest(F.lit(1), F.floor(length * epsilon)).cast("int")
    placed = feed.withColumn("slot", F.col("rank") - (length - n_slots))
    joined = placed.join(
        picks.withColumnRenamed("item_id", "pick"), ["user_id", "slot"], "left"
    )
    return joined.select(
        "user_id",
        "rank",
        F.coalesce("pick", "item_id").alias("item_id"),
        F.col("pick").isNotNull().alias("is_exploration"),
    )


# ---- baselines and lists ---------------------------------------------------------------


def popularity_list(counts: DataFrame, n: int) -> DataFrame:
    """The n most interacted items, ranked (ties: lower id)."""
    top = counts.orderBy(F.desc("interactions"), "item_id").limit(n)
    # At most n rows reach this window.
    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("interactions"), "item_id"))
    )


def spread_list(users: DataFrame, ranked: DataFrame) -> DataFrame:
    """Give every user the same short ranked list."""
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "item_id")))).scalar()
    listed = users.select("user_id", rows.alias("_rows"))
    return listed.select("user_id", F.inline("_rows"))


def popularity_recommend(users: DataFrame, counts: DataFrame, n: int = C.FEED_SIZE) -> DataFrame:
    return spread_list(users, popularity_list(counts, n))


def random_recommend(
    users: DataFrame, catalogue: DataFrame, n: int = C.FEED_SIZE, seed: str = "random"
) -> DataFrame:
    """A uniform n-subset of the catalogue per user, in random order.

    Floyd's sampling draws catalogue positions with n hashes per user, so no
    user meets the whole catalogue; positions are then joined to items.
    """
    size = catalogue.agg(F.count("*")).scalar()
    sized = users.select("user_id", size.alias("_size"))
    taken = F.least(F.lit(n).cast("bigint"), F.col("_size"))

    def step(chosen: Column, j: Column) -> Column:
        draw = F.floor(H.hash_uniform(seed, F.col("user_id"), j) * (j + 1)).cast("bigint")
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, draw), j).otherwise(draw)))

    tops = F.sequence(F.col("_size") - taken, F.col("_size") - 1)
    subset = F.aggregate(tops, F.array().cast("array<bigint>"), step)
    shuffled = F.array_sort(
        F.transform(subset, lambda i: F.struct(H.hash_uniform(seed, F.lit("order"), F.col("user_id"), i), i.alias("i")))
    )
    # The outer form infers no "not empty" filter, which the optimizer would
    # push, with the whole draw, below the aggregation that made the users.
    drawn = sized.withColumn("_drawn", shuffled).select(
        "user_id", F.posexplode_outer(F.col("_drawn").getField("i")).alias("pos", "index")
    )
    numbered = global_row_number(catalogue.select("item_id"), "item_id", "n")
    located = numbered.select("item_id", (F.col("n") - 1).alias("index"))
    return drawn.join(located, "index").select(
        "user_id", "item_id", (F.col("pos") + 1).alias("rank")
    )


def impression_log(feed: DataFrame) -> DataFrame:
    """One row per served feed: item ids in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return feed.groupBy("user_id").agg(rows.alias("r")).select(
        "user_id", F.col("r.item_id").alias("item_ids")
    )
