"""User and item features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar import schemas
from lodestar.functions import events as E
from lodestar.functions import hashing as H
from lodestar.functions import vectors as V
from lodestar.functions.joins import counted_join, lookup_join
from lodestar.sources.storage import cut_lineage

# ---- item counters -----------------------------------------------------------


def embedded_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("embedding").isNotNull())


def count_by_event_type(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("item_id", "event_type").agg(F.count("*").alias("n"))


def impression_counts(interactions: DataFrame) -> DataFrame:
    shown = interactions.filter(E.is_impression(F.col("event_type")))
    return shown.groupBy("item_id").agg(F.count("*").alias("impression_count"))


def item_ctr(interactions: DataFrame) -> DataFrame:
    """Clicks over impressions per item; 0 when never shown."""
    kind = F.col("event_type")
    clicks = F.count_if(kind == "click")
    shown = F.count_if(E.is_impression(kind))
    return interactions.groupBy("item_id").agg(
        clicks.alias("clicks"), shown.alias("impressions"), E.safe_ratio(clicks, shown).alias("ctr")
    )


def item_popularity(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("item_id").agg(F.count("*").alias("interactions"))


def unique_viewers_exact(interactions: DataFrame) -> DataFrame:
    """Distinct users per item; pairs are combined before the shuffle."""
    pairs = interactions.select("item_id", "user_id").distinct()
    return pairs.groupBy("item_id").agg(F.count("user_id").alias("viewers"))


def unique_viewers_sketch(interactions: DataFrame) -> DataFrame:
    """Mergeable HyperLogLog sketch per (item, day)."""
    return interactions.groupBy("item_id", F.to_date("created_at").alias("day")).agg(
        F.hll_sketch_agg("user_id").alias("sketch")
    )


def unique_viewers_hll(daily: DataFrame) -> DataFrame:
    """Approximate viewers per item from daily sketches."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return daily.groupBy("item_id").agg(merged.alias("viewers"))


# ---- cold start --------------------------------------------------------------


#: Standard error of a default sketch (2^12 cells), as a share of the count.
SKETCH_ERROR = 1.04 / 2**6


def sketch_check(estimates: DataFrame, exact: DataFrame, errors: float = 3.0) -> DataFrame:
    """Exact viewers of every item, and whether its estimate lies within ``errors`` standard errors (or one viewer)."""
    both = exact.select("item_id", "viewers").join(
        estimates.select("item_id", F.col("viewers").alias("estimate")), "item_id", "left"
    )
    allowed = F.greatest(F.lit(1.0), F.lit(errors * SKETCH_ERROR) * F.col("viewers"))
    within = F.abs(F.coalesce("estimate", F.lit(-1)) - F.col("viewers")) <= allowed
    return both.select("item_id", "viewers", within.alias("within"))


def user_interaction_count(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.count("*").alias("interaction_count"))


def user_cold_start(users: DataFrame, interactions: DataFrame) -> DataFrame:
    counts = user_interaction_count(interactions)
    count = F.coalesce("interaction_count", F.lit(0))
    return users.join(counts, "user_id", "left").select(
        "user_id",
        count.alias("interaction_count"),
        (count < C.USER_COLD_START_INTERACTIONS).alias("is_cold_start"),
    )


def item_cold_start(items: DataFrame, interactions: DataFrame) -> DataFrame:
    count = F.coalesce("impression_count", F.lit(0))
    return items.join(impression_counts(interactions), "item_id", "left").select(
        "item_id",
        count.alias("impression_count"),
        (count < C.ITEM_COLD_START_IMPRESSIONS).alias("is_cold_start"),
    )


def forced_exploration(
    items: DataFrame,
    interactions: DataFrame,
    seed: str = "explore",
    rate: float = C.FORCED_EXPLORATION_RATE,
) -> DataFrame:
    """Cold items that won the exploration draw."""
    cold = item_cold_start(items, interactions).filter("is_cold_start")
    draw = H.hash_uniform(seed, F.col("item_id"))
    return cold.filter(draw < rate).select("item_id", "impression_count", draw.alias("draw"))


# ---- freshness, trending -----------------------------------------------------


def freshness_scores(items: DataFrame, now: Column) -> DataFrame:
    return items.select("item_id", E.freshness(F.col("created_at"), now).alias("freshness"))


def relative_popularity(interactions: DataFrame) -> DataFrame:
    """Interactions per item divided by those of the busiest item."""
    counts = item_popularity(interactions)
    top = counts.agg(F.max("interactions")).scalar()
    return counts.select("item_id", (F.col("interactions") / top).alias("popularity"))


def composite_scores(items: DataFrame, interactions: DataFrame, now: Column) -> DataFrame:
    popularity = F.coalesce("popularity", F.lit(0.0))
    fresh = E.freshness(F.col("created_at"), now)
    return items.join(relative_popularity(interactions), "item_id", "left").select(
        "item_id", E.composite(fresh, popularity).alias("score")
    )


def trending_scores(
    interactions: DataFrame, now: Column, horizon_seconds: int = C.TRENDING_HORIZON_SECONDS
) -> DataFrame:
    """Positive signal per item within the horizon before ``now``."""
    weight = E.signal_weight(F.col("event_type"))
    recent = interactions.filter(
        (F.col("created_at") > E.ago(now, horizon_seconds)) & (F.col("created_at") <= now)
    )
    positive = recent.filter(weight > 0)
    return positive.groupBy("item_id").agg(F.sum(weight).alias("score"))


def top_by_score(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "item_id").limit(n)


def trending_flags(scores: DataFrame, z: float = C.TRENDING_Z_THRESHOLD) -> DataFrame:
    """Items whose score lies more than ``z`` deviations above the trending mean."""
    pool = top_by_score(scores, C.TRENDING_POOL)
    stats = pool.agg(
        F.struct(
            F.avg("score").alias("mean"),
            F.stddev_pop("score").alias("std"),
            F.count("*").alias("n"),
        )
    ).scalar()
    std = F.when(stats["std"] > 0, stats["std"]).otherwise(1e-9)
    zscore = (F.col("score") - stats["mean"]) / std
    flag = (zscore > z) & (stats["n"] >= C.TRENDING_MIN_ITEMS)
    return pool.select("item_id", "score", zscore.alias("zscore"), flag.alias("is_trending"))


# ---- user features -----------------------------------------------------------


def recent_items(
    interactions: DataFrame,
    limit: int = C.RECENT_ITEMS_LIMIT,
    since: Column | None = None,
) -> DataFrame:
    """Per user the distinct items touched last, newest first."""
    if since is not None:
        interactions = interactions.filter(F.col("created_at") > since)
    latest = interactions.groupBy("user_id", "item_id").agg(F.max("created_at").alias("touched_at"))
    return latest_items(latest, limit)


def latest_items(latest: DataFrame, limit: int = C.RECENT_ITEMS_LIMIT) -> DataFrame:
    """The same from (user_id, item_id, touched_at) rows."""
    order = Window.partitionBy("user_id").orderBy(F.desc("touched_at"), "item_id")
    return latest.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= limit
    )


def user_history(
    interactions: DataFrame, now: Column, days: int = 30, limit: int = 500
) -> DataFrame:
    recent = interactions.filter(F.col("created_at") >= E.ago(now, days * 86400))
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return recent.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= limit
    )


def preferred_categories(users: DataFrame) -> DataFrame:
    parsed = F.from_json("metadata", schemas.USER_METADATA)
    return users.select(
        "user_id",
        F.coalesce(parsed["onboarding_categories"], F.array().cast("array<string>")).alias(
            "categories"
        ),
    )


def merge_metadata(base: Column, update: Column) -> Column:
    """Shallow merge of two string maps; the update wins."""
    kept = F.map_filter(base, lambda key, _: ~F.map_contains_key(update, key))
    return F.map_concat(kept, update)


def touches(
    interactions: DataFrame, now: Column, horizon_seconds: int = C.TRENDING_HORIZON_SECONDS
) -> DataFrame:
    """One row per (user, item): all that profiles need, from one scan of the events.

    Signal sums are multiples of 0.25, so they are exact in any order.
    """
    kind = F.col("event_type")
    weight = E.signal_weight(kind)
    positive = F.when(weight > 0, weight).otherwise(0.0)
    live = (F.col("created_at") > E.ago(now, horizon_seconds)) & (F.col("created_at") <= now)
    return interactions.groupBy("user_id", "item_id").agg(
        F.count("*").alias("n"),
        F.sum(weight).alias("w"),
        F.sum(positive).alias("signal"),
        F.sum(F.when(live, positive).otherwise(0.0)).alias("trending"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(E.is_impression(kind)).alias("impressions"),
        F.max("created_at").alias("touched_at"),
    )


def category_affinity(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each category in a user's positive signal."""
    weight = E.signal_weight(F.col("event_type"))
    positive = interactions.filter(weight > 0)
    per_item = positive.groupBy("user_id", "item_id").agg(F.sum(weight).alias("signal"))
    return affinity_of(per_item, items)


def affinity_of(per_item: DataFrame, items: DataFrame) -> DataFrame:
    """The same from (user_id, item_id, signal) rows."""
    per_category = (
        per_item.filter("signal > 0")
        .join(items.select("item_id", "category"), "item_id")
        .groupBy("user_id", "category")
        .agg(F.sum("signal").alias("signal"))
    )
    total = F.sum("signal").over(Window.partitionBy("user_id"))
    return per_category.select(
        "user_id", "category", (F.col("signal") / total).alias("affinity")
    )


def user_embeddings(interactions: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """Signal-weighted mean of the vectors a user touched, scaled to unit length.

    Events collapse to one weight per (user, item) before vectors are joined.
    """
    weight = E.signal_weight(F.col("event_type"))
    touched = interactions.groupBy("user_id", "item_id").agg(
        F.sum(weight).alias("w"), F.count("*").alias("n")
    )
    return embeddings_of(touched, items, dim)


def embeddings_of(touched: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """The same from (user_id, item_id, w, n) rows."""
    vectors = embedded_items(items).select("item_id", "embedding")
    summed = (
        touched.select("user_id", "item_id", "w", "n")
        .join(vectors, "item_id")
        .groupBy("user_id")
        .agg(V.vector_sum("embedding", dim, "w").alias("total"), F.sum("n").alias("n"))
    )
    count = F.col("n")
    mean = F.transform("total", lambda x: x / count)
    return summed.select("user_id", mean.alias("mean")).select(
        "user_id", V.l2_normalize(F.col("mean")).alias("embedding")
    )


def cold_start_embedding(categories: Column, dim: int, seed: str = "cold") -> Column:
    """Prior vector N(0, 0.1) that depends only on the sorted category set."""
    key = F.array_join(F.array_sort(categories), ",")
    key = F.when(F.size(categories) > 0, key).otherwise("__none__")

    def gaussian(i: Column) -> Column:
        u1 = F.lit(1.0) - H.hash_uniform(seed, F.lit("a"), key, i)
        u2 = H.hash_uniform(seed, F.lit("b"), key, i)
        radius = F.sqrt(F.lit(-2.0) * F.ln(u1))
        return F.lit(0.1) * radius * F.cos(F.lit(6.283185307179586) * u2)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), gaussian)


def serving_embeddings(users: DataFrame, learned: DataFrame, dim: int) -> DataFrame:
    """Every user's vector: learned where there is one, else the cold-start prior."""
    prior = cold_start_embedding(F.col("categories"), dim)
    return preferred_categories(users).join(learned, "user_id", "left").select(
        "user_id",
        F.coalesce("embedding", prior).alias("embedding"),
        F.col("embedding").isNull().alias("is_cold_start"),
    )


# ---- lookups -----------------------------------------------------------------


def rows_by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_semi")


def batch_item_features(requested: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per requested id; unknown ids score 0.0."""
    return requested.join(scores, "item_id", "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def ttl_lookup(
    log: DataFrame, key: str, value: str, now: Column, ttl_seconds: int, ts: str = "created_at"
) -> DataFrame:
    """Latest value per key, visible only while younger than the TTL."""
    live = log.filter((F.col(ts) <= now) & (F.col(ts) > E.ago(now, ttl_seconds)))
    return live.groupBy(key).agg(
        F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias("written_at")
    )


# ---- training-frame columns ---------------------------------------------------


def pad_sequence(sequence: Column, length: int = C.SEQUENCE_LENGTH) -> Column:
    """Last ``length`` entries, filled with zeros on the left."""
    kept = F.slice(sequence, F.greatest(F.size(sequence) - length, F.lit(0)) + 1, F.lit(length))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size(kept))
    return F.concat(zeros, kept)


def sequences_before(interactions: DataFrame, length: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """(event_id, sequence): items of the user's ``length`` events before each event, oldest first."""
    before = Window.partitionBy("user_id").orderBy("created_at", "event_id").rowsBetween(-length, -1)
    return interactions.select("event_id", F.collect_list("item_id").over(before).alias("sequence"))


def ctr_before(interactions: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(item_id, day, ctr, n): click rate of all events before the day, for the (item_id, day) of ``asked``.

    Without ``asked`` the days are the events' own; ``n`` counts the rows that
    ask. Daily counts and asked days are merged in one order per item and the
    running sums carried, so an item has a row per day that is asked or has events,
    not one per day of the calendar. Pairs without an earlier impression are left out.
    """
    kind = F.col("event_type")
    daily = interactions.groupBy("item_id", F.to_date("created_at").alias("day")).agg(
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(E.is_impression(kind)).alias("impressions"),
        (F.count(F.lit(1)) if asked is None else F.lit(0).cast("bigint")).alias("n"),
    )
    if asked is not None:
        none = F.lit(0).cast("bigint")
        wanted = asked.groupBy("item_id", "day").agg(F.count(F.lit(1)).alias("n"))
        daily = daily.unionByName(wanted.withColumns({"clicks": none, "impressions": none}))
    earlier = Window.partitionBy("item_id").orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -1)
    ratio = E.safe_ratio(F.sum("clicks").over(earlier), F.sum("impressions").over(earlier))
    rated = daily.withColumn("ctr", F.when(F.sum("impressions").over(earlier) > 0, ratio))
    return rated.where("n > 0 AND ctr IS NOT NULL").select("item_id", "day", "ctr", "n")


def training_frame(interactions: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """The training columns of every event, with sequence, freshness and click rate as of the event.

    ``users`` holds the vectors of the dot product; without one it is 0.0.
    """
    encoded = lookup_join(
        interactions.join(sequences_before(interactions), "event_id"),
        items.select("item_id", "category", "embedding", F.col("created_at").alias("published_at")),
        ["item_id"],
        F.col("event_id"),
        row_bytes=16 << 10,  # vectors of up to 2,000 numbers
    ).withColumn("day", F.to_date("created_at"))
    rates = cut_lineage(ctr_before(interactions))
    rated = counted_join(encoded, rates, ["item_id", "day"], F.col("event_id"), "n")
    known = rated.join(users.select("user_id", F.col("embedding").alias("u")), "user_id", "left")
    return known.select(
        "event_id",
        "user_id",
        "item_id",
        E.list_index(F.col("category"), C.CATEGORIES).alias("category_id"),
        E.list_index(F.col("device"), C.DEVICES).alias("device_id"),
        F.hour("created_at").alias("time_of_day"),
        (F.col("event_type") == "click").cast("int").alias("label"),
        pad_sequence(F.col("sequence")).alias("recent_item_sequence"),
        F.col("embedding").cast("array<float>").alias("content_embedding"),
        E.freshness(F.col("published_at"), F.col("created_at")).alias("freshness_score"),
        F.coalesce("ctr", F.lit(0.0)).alias("historical_ctr"),
        F.coalesce(V.dot(F.col("u"), F.col("embedding")), F.lit(0.0)).alias("user_item_dot_product"),
    )


def categorical_encode(interactions: DataFrame, items: DataFrame) -> DataFrame:
    joined = lookup_join(interactions, items.select("item_id", "category"), ["item_id"], F.col("event_id"))
    return joined.select(
        "user_id",
        "item_id",
        E.list_index(F.col("category"), C.CATEGORIES).alias("category_id"),
        E.list_index(F.col("device"), C.DEVICES).alias("device_id"),
        F.hour("created_at").alias("time_of_day"),
        (F.col("event_type") == "click").cast("int").alias("label"),
    )


def newest_per_category(items: DataFrame, n: int = 100) -> DataFrame:
    order = Window.partitionBy("category").orderBy(F.desc("created_at"), "item_id")
    return items.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def newest(table: DataFrame, key: str, n: int) -> DataFrame:
    return table.orderBy(F.desc("created_at"), key).limit(n)
