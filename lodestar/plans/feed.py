"""The personalised feed of all users as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions import hashing as H
from lodestar.functions.joins import lookup_join
from lodestar.operators import experiments as X
from lodestar.operators import features, ranking, retrieval
from lodestar.sources.storage import cut_lineage


@dataclass(frozen=True)
class FeedSettings:
    dim: int
    depth: int = C.ANN_K
    size: int = C.FEED_SIZE
    trending_horizon_seconds: int = C.TRENDING_HORIZON_SECONDS
    experiment: str = "two_tower_v1_vs_baseline"


def learned_embeddings(interactions: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    return features.user_embeddings(interactions, items, dim)


def ranked_positions(scores: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n items of a shared list with their positions."""
    head = scores.orderBy(*order).limit(n)
    # Only n rows are left for this window.
    return head.select("item_id", F.row_number().over(Window.orderBy(*order)).alias("position"))


def shared_lists(
    interactions: DataFrame, items: DataFrame, now: Column, horizon: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exploration list, trending list, trending flags) used by every feed."""
    trending = features.trending_scores(interactions, now, horizon)
    flags = features.trending_flags(trending)
    exploration = features.forced_exploration(items, interactions)
    return (
        ranked_positions(exploration, [F.col("draw"), F.col("item_id")], C.EXPLORATION_CANDIDATES),
        ranked_positions(trending, [F.desc("score"), F.col("item_id")], C.TRENDING_CANDIDATES),
        flags,
    )


def candidates_of(
    vectors: DataFrame,
    users: DataFrame,
    items: DataFrame,
    exploration: DataFrame,
    trending: DataFrame,
    depth: int,
) -> DataFrame:
    """Candidate rows per user in table form."""
    retrieved = retrieval.vector_topk(vectors, features.embedded_items(items), depth, listed=True)
    return retrieval.candidate_union(retrieved, users, exploration, trending)


def candidate_features(
    found: DataFrame, interactions: DataFrame, items: DataFrame, now: Column
) -> DataFrame:
    return ranking.ranking_features(
        found,
        items,
        features.category_affinity(interactions, items),
        features.item_ctr(interactions),
        features.relative_popularity(interactions),
        now,
    )


def item_stats(touches: DataFrame, items: DataFrame) -> DataFrame:
    """Counters of every catalogue item, from the pre-aggregated touches."""
    stats = touches.groupBy("item_id").agg(
        F.sum("n").alias("n"),
        F.sum("impressions").alias("impressions"),
        E.safe_ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
        F.round(F.sum("w") / F.sum("n"), 6).alias("mean_reward"),
        F.sum("trending").alias("trending"),
    )
    return items.select("item_id").join(stats, "item_id", "left")


def shared_lists_of(stats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exploration list, trending list, trending flags) from item counters."""
    draw = H.hash_uniform("explore", F.col("item_id"))
    cold = F.coalesce("impressions", F.lit(0)) < C.ITEM_COLD_START_IMPRESSIONS
    exploration = stats.filter(cold & (draw < C.FORCED_EXPLORATION_RATE)).select(
        "item_id", draw.alias("draw")
    )
    trending = stats.filter("trending > 0").select("item_id", F.col("trending").alias("score"))
    return (
        ranked_positions(exploration, [F.col("draw"), F.col("item_id")], C.EXPLORATION_CANDIDATES),
        ranked_positions(trending, [F.desc("score"), F.col("item_id")], C.TRENDING_CANDIDATES),
        features.trending_flags(trending),
    )


def item_profiles(stats: DataFrame, items: DataFrame, flags: DataFrame, now: Column) -> DataFrame:
    """What the ranking of an item needs."""
    top = stats.agg(F.max("n")).scalar()
    zero = F.lit(0.0)
    return (
        items.join(stats, "item_id", "left")
        .join(flags.select("item_id", "is_trending"), "item_id", "left")
        .select(
            "item_id",
            "category",
            "created_at",
            "mean_reward",
            "is_trending",
            E.freshness(F.col("created_at"), now).alias("freshness"),
            F.coalesce("ctr", zero).alias("ctr"),
            F.coalesce(F.col("n") / top, zero).alias("popularity"),
        )
    )


def user_profiles(
    touches: DataFrame, items: DataFrame, users: DataFrame, dim: int
) -> DataFrame:
    """One row per user: vector, cold flag, affinity by category, recent items."""
    learned = features.embeddings_of(touches, items, dim)
    affinity = features.affinity_of(touches, items).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "affinity"))).alias("affinity")
    )
    recent = features.latest_items(touches.select("user_id", "item_id", "touched_at"))
    seen = recent.groupBy("user_id").agg(F.collect_list("item_id").alias("recent"))
    vectors = features.serving_embeddings(users, learned, dim)
    return vectors.join(affinity, "user_id", "left").join(seen, "user_id", "left")


def packed_candidates(
    profiles: DataFrame, items: DataFrame, exploration: DataFrame, trending: DataFrame, depth: int
) -> DataFrame:
    """(user_id, item_id, score, profile columns): retrieval plus injected items.

    The result stays partitioned by user.
    """
    found = retrieval.vector_topk(
        profiles.select("user_id", "embedding"), features.embedded_items(items), depth, listed=True
    )
    explore_ids = exploration.agg(F.collect_list("item_id")).scalar()
    trending_ids = trending.agg(F.collect_list("item_id")).scalar()
    # Shuffled as two arrays of numbers, two thirds of the bytes of an array of pairs.
    lists = profiles.drop("embedding", "is_cold_start").join(found.hint("merge"), "user_id", "left")
    pairs = F.arrays_zip(F.col("found").alias("item_id"), F.col("scores").alias("score"))
    joined = lists.withColumn("found", pairs).drop("scores")
    retrieved_ids = F.coalesce(F.col("found.item_id"), F.array().cast("array<bigint>"))
    extra = F.array_except(F.array_union("explore_ids", "trending_ids"), "retrieved_ids")
    rows = (
        joined.withColumns({"explore_ids": explore_ids, "trending_ids": trending_ids})
        .withColumn("retrieved_ids", retrieved_ids)
        .withColumn("extra", F.transform(extra, lambda i: F.struct(i.alias("item_id"), F.lit(0.0).alias("score"))))
        .withColumn("candidate", F.explode(F.concat(F.coalesce("found", F.slice("extra", 1, 0)), "extra")))
    )
    return rows.select(
        "user_id", "affinity", "recent", "candidate.item_id", "candidate.score"
    )


def personalized_feed(
    interactions: DataFrame,
    items: DataFrame,
    users: DataFrame,
    experiments: DataFrame,
    now: Column,
    settings: FeedSettings,
    score: Column | PipelineModel | None = None,
) -> DataFrame:
    """(user_id, rank, item_id, score, category, flags, variant) for every user.

    The events are scanned once, into (user, item) touches; profiles of users
    and counters of items are derived from these and stored, as they are
    refreshed apart from requests. ``score`` is an expression over the ranking
    features or a trained ranker. After retrieval each user's candidates live
    in one partition: ranking, diversity, exploration and the category cap work
    on one packed row per user.
    """
    touches = cut_lineage(features.touches(interactions, now, settings.trending_horizon_seconds))
    stats = cut_lineage(item_stats(touches, items))
    profiles = cut_lineage(user_profiles(touches, items, users, settings.dim))
    exploration, trending, flags = shared_lists_of(stats)
    catalogue = item_profiles(stats, items, flags, now)
    found = packed_candidates(profiles, items, exploration, trending, settings.depth)
    row_bytes, most_bytes = ranking.CATALOGUE_BYTES, ranking.CATALOGUE_MOST
    joined = lookup_join(found, catalogue, ["item_id"], F.col("user_id"), "left", row_bytes, most_bytes, counted=items)
    affinity = F.coalesce(F.element_at("affinity", F.col("category")), F.lit(0.0))
    zero = F.lit(0.0)
    values = [
        F.col("score"),
        F.coalesce("freshness", zero),
        affinity,
        F.lit(1.0) - F.hour(now) / 24.0,
        F.lit(1.0) - affinity,
        F.coalesce("ctr", zero),
        F.coalesce("popularity", zero),
    ]
    featured = joined.withColumns(dict(zip(C.RANKING_FEATURES, values)))
    scored = ranking.with_score(featured, score)
    seen = F.coalesce(F.array_contains("recent", F.col("item_id")), F.lit(False))
    adjusted = ranking.adjusted_score(scored.withColumn("seen", seen), now)
    served = _serve(adjusted, items, settings)
    assigned = X.assign_one(profiles.select("user_id", "is_cold_start"), experiments, settings.experiment)
    return served.join(assigned, "user_id")


def _serve(adjusted: DataFrame, items: DataFrame, settings: FeedSettings) -> DataFrame:
    """Diversity, category cap and exploration slots on one packed row per user."""
    n, epsilon, seed = settings.size, C.BANDIT_EPSILON, "bandit"
    slots = max(1, int(n * epsilon))
    prepared = adjusted.withColumns(
        {
            "is_trending": F.coalesce("is_trending", F.lit(False)),
            "u": H.hash_uniform(seed, F.col("user_id"), F.col("item_id")),
        }
    )
    columns = ["item_id", "score", "category", "is_trending", "freshness_boosted", "mean_reward", "u"]
    picked = ranking.mmr_pick(prepared, items, columns, n)
    pool = F.filter("c", lambda _, i: ~F.array_contains("picked", i))
    random_order = F.array_sort(
        F.transform("pool", lambda x: F.struct(x["u"].alias("u"), x["item_id"].alias("item_id")))
    )
    best_order = F.array_sort(
        F.transform(
            "pool",
            lambda x: F.struct(
                x["mean_reward"].isNull().alias("unknown"),
                (-x["mean_reward"]).alias("reward"),
                F.when(x["mean_reward"].isNull(), x["u"]).alias("u"),
                x["item_id"].alias("item_id"),
            ),
        )
    )
    listed = (
        picked.withColumn("pool", pool)
        .withColumn("randoms", F.slice(random_order, 1, slots).getField("item_id"))
        .withColumn("bests", F.slice(best_order, 1, 2 * slots).getField("item_id"))
        .drop("pool")
    )
    with_picks = ranking.slot_picks(listed, slots, epsilon, seed).withColumn(
        "picks",
        F.transform("picks", lambda i: F.element_at(F.filter("c", lambda x: x["item_id"] == i), 1)),
    )
    rows = with_picks.select(
        "user_id",
        "picks",
        F.size("picked").alias("length"),
        F.transform("picked", lambda p: F.element_at("c", p + 1)).alias("feed"),
    ).select("user_id", "picks", "length", F.posexplode_outer("feed").alias("pos", "item"))
    # Only the final rows are shuffled again (the Python step hides that they
    # are already grouped by user).
    capped = ranking.category_cap(rows.select("*", (F.col("pos") + 1).alias("rank"), "item.category"))
    n_slots = F.greatest(F.lit(1), F.floor(F.col("length") * epsilon)).cast("int")
    slot = F.col("rank") - (F.col("length") - n_slots)
    pick = F.when((slot >= 1) & (slot <= F.size("picks")), F.get("picks", slot - 1))
    final = capped.withColumn("pick", pick).withColumn("item", F.coalesce("pick", "item"))
    return final.select(
        "user_id",
        "rank",
        "item.item_id",
        "item.score",
        "item.category",
        "item.is_trending",
        "item.freshness_boosted",
        F.col("pick").isNotNull().alias("is_exploration"),
    )


def holdback_feed(
    feed: DataFrame, users: DataFrame, interactions: DataFrame, size: int = C.FEED_SIZE
) -> DataFrame:
    """Popularity list for users in the global holdback, their own feed otherwise."""
    flagged = users.select("user_id", X.holdback_flag(F.col("user_id")).alias("holdback"))
    popular = ranking.popularity_recommend(
        flagged.filter("holdback"), features.item_popularity(interactions), size
    )
    personal = feed.join(flagged.filter("NOT holdback"), "user_id", "left_semi")
    return popular.select("user_id", "item_id", "rank", F.lit(True).alias("holdback")).unionByName(
        personal.select("user_id", "item_id", "rank", F.lit(False).alias("holdback"))
    )
