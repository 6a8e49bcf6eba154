"""User and item features, lookups and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions import vectors as V
from lodestar.operators import features
from lodestar.plans.event_queries import us
from lodestar.plans.feed import learned_embeddings
from lodestar.plans.registry import query
from lodestar.plans.views import (
    IMPRESSION_SQL,
    NOW_SQL,
    VIEWS,
    freshness_sql,
    sql_list,
    uniform_sql,
    weight_sql,
)
from lodestar.sources.bindings import Tables, now

DIM = 64
DAY = 86400

CTR_SQL = f"""coalesce(count(*) FILTER (event_type = 'click')
  / nullif(count(*) FILTER ({IMPRESSION_SQL}), 0)::DOUBLE, 0)"""

VIEWS["popularity"] = """
SELECT item_id, count(*) / (SELECT max(n) FROM (SELECT count(*) AS n FROM interactions GROUP BY item_id))::DOUBLE
  AS popularity FROM interactions GROUP BY item_id"""
VIEWS["ctrs"] = f"SELECT item_id, {CTR_SQL} AS ctr FROM interactions GROUP BY item_id"
VIEWS["trending"] = f"""
SELECT item_id, sum({weight_sql()}) AS score FROM interactions
WHERE created_at > {NOW_SQL} - INTERVAL 1 DAY AND created_at <= {NOW_SQL} AND {weight_sql()} > 0
GROUP BY item_id"""
VIEWS["affinities"] = f"""
SELECT user_id, category, sum(w) / sum(sum(w)) OVER (PARTITION BY user_id) AS affinity
FROM (SELECT user_id, category, {weight_sql()} AS w FROM interactions JOIN items USING (item_id))
WHERE w > 0 GROUP BY user_id, category"""
VIEWS["recent"] = """
SELECT user_id, item_id, touched_at, position FROM (
  SELECT user_id, item_id, max(created_at) AS touched_at, row_number() OVER (
    PARTITION BY user_id ORDER BY max(created_at) DESC, item_id) AS position
  FROM interactions GROUP BY user_id, item_id)
WHERE position <= 50"""
VIEWS["learned"] = f"""
SELECT user_id, list(x / (sqrt(ss) + 1e-9::DOUBLE) ORDER BY pos) AS vec FROM (
  SELECT user_id, pos, x, sum(x * x) OVER (PARTITION BY user_id) AS ss FROM (
    SELECT user_id, pos, sum(embedding[pos] * w) / sum(n) AS x FROM (
      SELECT i.user_id, it.embedding, i.w, i.n, unnest(range(1, {DIM + 1})) AS pos
      FROM (SELECT user_id, item_id, sum({weight_sql()}) AS w, count(*) AS n
            FROM interactions GROUP BY user_id, item_id) i
      JOIN items it USING (item_id))
    GROUP BY user_id, pos))
GROUP BY user_id"""
_PRIOR_KEY = "array_to_string(list_sort(onboarding_categories), ',')"
VIEWS["priors"] = f"""
SELECT user_id, list(0.1::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {uniform_sql("'cold:a:' || k || ':' || i")}))
    * cos(6.283185307179586::DOUBLE * {uniform_sql("'cold:b:' || k || ':' || i")}) ORDER BY i) AS vec
FROM (SELECT user_id, {_PRIOR_KEY} AS k, unnest(range(0, {DIM})) AS i FROM users)
GROUP BY user_id"""
VIEWS["serving"] = """
SELECT p.user_id, coalesce(l.vec, p.vec) AS vec, l.vec IS NULL AS is_cold_start
FROM priors p LEFT JOIN learned l ON l.user_id = p.user_id"""


def rounded(vector, digits: int = 6):
    """Vector as text with fixed digits, the form both engines print alike."""
    return F.array_join(F.transform(vector, lambda x: F.round(x * 10**digits).cast("bigint").cast("string")), ",")


def rounded_sql(vector: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: CAST(round(x * {10**digits}) AS BIGINT)), ',')"


@query(
    "user_cold_start",
    f"""
SELECT user_id, coalesce(n, 0) AS interaction_count, coalesce(n, 0) < {C.USER_COLD_START_INTERACTIONS} AS is_cold_start
FROM (SELECT c_custkey AS user_id FROM customer)
LEFT JOIN (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id) USING (user_id)
""",
)
def _(t: Tables):
    everyone = t.raw("customer").select(F.col("c_custkey").alias("user_id"))
    return features.user_cold_start(everyone, t.interactions)


@query(
    "item_cold_start",
    f"""
SELECT item_id, coalesce(n, 0) AS impression_count, coalesce(n, 0) < {C.ITEM_COLD_START_IMPRESSIONS} AS is_cold_start
FROM items LEFT JOIN (SELECT item_id, count(*) AS n FROM interactions WHERE {IMPRESSION_SQL} GROUP BY item_id)
  USING (item_id)
""",
)
def _(t: Tables):
    return features.item_cold_start(t.items, t.interactions)


@query("freshness_score", f"SELECT item_id, round({freshness_sql('created_at')}, 6) AS freshness FROM items")
def _(t: Tables):
    return features.freshness_scores(t.items, now()).withColumn("freshness", F.round("freshness", 6))


@query(
    "composite_score",
    f"""
SELECT item_id, round(0.3::DOUBLE * {freshness_sql('created_at')} + 0.7::DOUBLE * coalesce(popularity, 0), 6) AS score
FROM items LEFT JOIN popularity USING (item_id)
""",
)
def _(t: Tables):
    scores = features.composite_scores(t.items, t.interactions, now())
    return scores.withColumn("score", F.round("score", 6))


@query(
    "forced_exploration",
    f"""
SELECT item_id, coalesce(n, 0) AS impression_count
FROM items LEFT JOIN (SELECT item_id, count(*) AS n FROM interactions WHERE {IMPRESSION_SQL} GROUP BY item_id)
  USING (item_id)
WHERE coalesce(n, 0) < {C.ITEM_COLD_START_IMPRESSIONS} AND {uniform_sql("'explore:' || item_id")} < {C.FORCED_EXPLORATION_RATE}
""",
)
def _(t: Tables):
    return features.forced_exploration(t.items, t.interactions).drop("draw")


@query("l2_normalize", f"SELECT item_id, {rounded_sql('vec')} AS unit FROM unit_items")
def _(t: Tables):
    return t.items.select("item_id", rounded(V.l2_normalize(F.col("embedding"))).alias("unit"))


_PAIRS_SQL = """
FROM (SELECT DISTINCT user_id, item_id FROM interactions) p
JOIN items a USING (item_id) JOIN items b ON b.item_id = p.user_id % 50
"""


def _vector_pairs(t: Tables):
    """Touched items next to a fixed comparison item of the user."""
    pairs = t.interactions.select("user_id", "item_id").distinct()
    a = t.items.select("item_id", F.col("embedding").alias("a"))
    b = t.items.select(F.col("item_id").alias("other"), F.col("embedding").alias("b"))
    return pairs.withColumn("other", F.col("user_id") % 50).join(a, "item_id").join(b, "other")


@query(
    "dot_product",
    "SELECT user_id, item_id, round(list_inner_product(a.embedding, b.embedding), 6) AS dot" + _PAIRS_SQL,
)
def _(t: Tables):
    dot = V.dot(F.col("a"), F.col("b"))
    return _vector_pairs(t).select("user_id", "item_id", F.round(dot, 6).alias("dot"))


@query(
    "cosine_similarity",
    "SELECT user_id, item_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine" + _PAIRS_SQL,
)
def _(t: Tables):
    cosine = V.cosine(F.col("a"), F.col("b"))
    return _vector_pairs(t).select("user_id", "item_id", F.round(cosine, 6).alias("cosine"))


@query(
    "sigmoid_score",
    "SELECT user_id, item_id, round(1 / (1 + exp(-4 * list_inner_product(a.embedding, b.embedding))), 6) AS p"
    + _PAIRS_SQL,
)
def _(t: Tables):
    p = V.sigmoid(4.0 * V.dot(F.col("a"), F.col("b")))
    return _vector_pairs(t).select("user_id", "item_id", F.round(p, 6).alias("p"))


@query(
    "pad_sequence",
    f"""
SELECT user_id, array_to_string(list_concat(list_transform(range({C.SEQUENCE_LENGTH} - len(seq)), lambda x: 0), seq), ',')
  AS sequence
FROM (SELECT user_id, list(item_id ORDER BY position DESC) AS seq FROM recent GROUP BY user_id)
""",
)
def _(t: Tables):
    recent = features.recent_items(t.interactions)
    oldest_first = F.array_sort(F.collect_list(F.struct((-F.col("position")).alias("p"), "item_id")))
    sequences = recent.groupBy("user_id").agg(oldest_first.alias("s"))
    padded = features.pad_sequence(F.col("s.item_id"))
    return sequences.select("user_id", F.array_join(padded, ",").alias("sequence"))


@query(
    "categorical_encode",
    f"""
SELECT user_id, item_id, CAST(list_position({sql_list(C.CATEGORIES)}, category) - 1 AS INTEGER) AS category_id,
  CAST(list_position({sql_list(C.DEVICES)}, device) - 1 AS INTEGER) AS device_id,
  CAST(hour(i.created_at) AS INTEGER) AS time_of_day, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS label
FROM interactions i JOIN items USING (item_id)
""",
)
def _(t: Tables):
    return features.categorical_encode(t.interactions, t.items)


@query(
    "user_preferred_categories",
    "SELECT user_id, array_to_string(onboarding_categories, ',') AS categories FROM users",
)
def _(t: Tables):
    preferred = features.preferred_categories(t.users)
    return preferred.select("user_id", F.array_join("categories", ",").alias("categories"))


@query(
    "metadata_merge",
    """
SELECT user_id, 'web' AS device, 'en' AS locale, onboarding_categories[1] AS top_category FROM users
""",
)
def _(t: Tables):
    base = F.create_map(
        F.lit("device"), F.col("device"), F.lit("top_category"), F.col("onboarding_categories")[0]
    )
    update = F.create_map(F.lit("device"), F.lit("web"), F.lit("locale"), F.lit("en"))
    merged = t.users.select("user_id", features.merge_metadata(base, update).alias("m"))
    return merged.select("user_id", *[F.col("m")[k].alias(k) for k in ("device", "locale", "top_category")])


_UUID_TEXT = "lpad(lower(to_hex(event_id)), 8, '0') || '-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0')"


@query(
    "id_format_filter",
    f"SELECT event_id, {_UUID_TEXT} AS id FROM interactions WHERE event_id % 3 <> 0",
)
def _(t: Tables):
    # A third of the ids lacks its first block and must be refused.
    tail = F.concat(F.lit("-0000-4000-8000-"), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    head = F.lpad(F.lower(F.hex("event_id")), 8, "0")
    text = F.when(F.col("event_id") % 3 == 0, tail).otherwise(F.concat(head, tail))
    named = t.interactions.select("event_id", text.alias("id"))
    return named.filter(E.is_well_formed_uuid(F.col("id")))


# ---- lookups -----------------------------------------------------------------


@query(
    "items_by_ids",
    "SELECT item_id, category, content_text FROM items WHERE item_id IN (SELECT item_id FROM interactions)",
)
def _(t: Tables):
    return features.rows_by_ids(t.items, t.interactions, "item_id").select(
        "item_id", "category", "content_text"
    )


@query(
    "batch_item_features",
    """
SELECT r.item_id, round(coalesce(popularity, 0), 6) AS score
FROM (SELECT DISTINCT p_partkey AS item_id FROM part) r LEFT JOIN popularity USING (item_id)
""",
)
def _(t: Tables):
    requested = t.raw("part").select(F.col("p_partkey").alias("item_id"))
    scores = features.relative_popularity(t.interactions).select(
        "item_id", F.round("popularity", 6).alias("score")
    )
    return features.batch_item_features(requested, scores)


@query(
    "ttl_feature_lookup",
    f"""
SELECT user_id, arg_max(device_used, epoch_us(created_at)) AS device_used, epoch_us(max(created_at)) AS written_us
FROM (SELECT user_id, created_at, device || event_type AS device_used FROM interactions)
WHERE created_at <= {NOW_SQL} AND created_at > {NOW_SQL} - INTERVAL 7 DAY GROUP BY user_id
""",
)
def _(t: Tables):
    log = t.interactions.select(
        "user_id", "created_at", F.concat("device", "event_type").alias("device_used")
    )
    found = features.ttl_lookup(log, "user_id", "device_used", now(), C.EXPERIMENT_TTL_SECONDS)
    return found.select("user_id", "device_used", us("written_at", "written_us"))


# ---- aggregates ------------------------------------------------------------------


@query(
    "count_by_event_type",
    "SELECT item_id, event_type, count(*) AS n FROM interactions GROUP BY item_id, event_type",
)
def _(t: Tables):
    return features.count_by_event_type(t.interactions)


@query(
    "item_ctr",
    f"""
SELECT item_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER ({IMPRESSION_SQL}) AS impressions,
  round({CTR_SQL}, 6) AS ctr FROM interactions GROUP BY item_id
""",
)
def _(t: Tables):
    return features.item_ctr(t.interactions).withColumn("ctr", F.round("ctr", 6))


@query(
    "item_popularity",
    "SELECT item_id, count(*) AS interactions FROM purchases GROUP BY item_id",
)
def _(t: Tables):
    return features.item_popularity(t.purchases)


@query("trending_scores", "SELECT item_id, score FROM trending")
def _(t: Tables):
    return features.trending_scores(t.interactions, now(), DAY)


@query(
    "trending_zscore_flag",
    """
pool AS (SELECT * FROM trending ORDER BY score DESC, item_id LIMIT 1000),
stats AS (SELECT avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM pool)
---
SELECT item_id, score, round((score - m) / CASE WHEN s > 0 THEN s ELSE 1e-9 END, 6) AS zscore,
  (score - m) / CASE WHEN s > 0 THEN s ELSE 1e-9 END > 1.5 AND n >= 5 AS is_trending
FROM pool, stats
""",
)
def _(t: Tables):
    scores = features.trending_scores(t.interactions, now(), DAY)
    flags = features.trending_flags(scores, z=1.5)
    return flags.withColumn("zscore", F.round("zscore", 6))


@query("trending_topn", "SELECT item_id, score FROM trending ORDER BY score DESC, item_id LIMIT 10")
def _(t: Tables):
    return features.top_by_score(features.trending_scores(t.interactions, now(), DAY), 10)


@query("unique_viewers_hll")
def _(t: Tables):
    return features.unique_viewers_hll(features.unique_viewers_sketch(t.interactions))


@query(
    "unique_viewers_bound",
    "SELECT item_id, count(DISTINCT user_id) AS viewers, true AS within FROM interactions GROUP BY item_id",
)
def _(t: Tables):
    estimates = features.unique_viewers_hll(features.unique_viewers_sketch(t.interactions))
    return features.sketch_check(estimates, features.unique_viewers_exact(t.interactions))


@query(
    "unique_viewers_exact",
    "SELECT item_id, count(DISTINCT user_id) AS viewers FROM interactions GROUP BY item_id",
)
def _(t: Tables):
    return features.unique_viewers_exact(t.interactions)


@query(
    "user_interaction_count",
    "SELECT user_id, count(*) AS interaction_count FROM purchases GROUP BY user_id",
)
def _(t: Tables):
    return features.user_interaction_count(t.purchases)


# ---- windows ---------------------------------------------------------------------


@query("recent_items_50", "SELECT user_id, item_id, position::INTEGER AS position FROM recent")
def _(t: Tables):
    return features.recent_items(t.interactions).select("user_id", "item_id", "position")


@query(
    "user_history",
    f"""
SELECT user_id, event_id, position::INTEGER AS position FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS position
  FROM interactions WHERE created_at >= {NOW_SQL} - INTERVAL 30 DAY) WHERE position <= 500
""",
)
def _(t: Tables):
    return features.user_history(t.interactions, now()).select("user_id", "event_id", "position")


@query(
    "items_by_category",
    """
SELECT category, item_id, position::INTEGER AS position FROM (
  SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, item_id) AS position
  FROM items) WHERE position <= 20
""",
)
def _(t: Tables):
    return features.newest_per_category(t.items, 20).select("category", "item_id", "position")


@query("recent_users", "SELECT user_id, device FROM users ORDER BY created_at DESC, user_id LIMIT 50")
def _(t: Tables):
    return features.newest(t.users, "user_id", 50).select("user_id", "device")


@query(
    "category_affinity",
    "SELECT user_id, category, round(affinity, 6) AS affinity FROM affinities",
)
def _(t: Tables):
    affinity = features.category_affinity(t.interactions, t.items)
    return affinity.withColumn("affinity", F.round("affinity", 6))


@query("user_embedding", f"SELECT user_id, {rounded_sql('vec')} AS vec FROM learned")
def _(t: Tables):
    learned = learned_embeddings(t.interactions, t.items, DIM)
    return learned.select("user_id", rounded(F.col("embedding")).alias("vec"))


@query("cold_start_embedding", f"SELECT user_id, {rounded_sql('vec')} AS vec, is_cold_start FROM serving")
def _(t: Tables):
    learned = learned_embeddings(t.interactions, t.items, DIM)
    served = features.serving_embeddings(t.users, learned, DIM)
    return served.select("user_id", rounded(F.col("embedding")).alias("vec"), "is_cold_start")
