"""Retrieval, ranking, diversity, exploration and the feed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions.rounding import round_double
from lodestar.operators import features, ivf, ranking, retrieval
from lodestar.plans import feed
from lodestar.plans.feature_queries import DAY, DIM
from lodestar.plans.registry import query
from lodestar.plans.views import NOW_SQL, VIEWS, freshness_sql, hash_mod_sql, uniform_sql, weight_sql
from lodestar.sources.bindings import Tables, now
from lodestar.sources.storage import cut_lineage

DEPTH = C.ANN_K
SIZE = C.FEED_SIZE
SLOTS = 2

VIEWS["unit_users"] = """
SELECT user_id, is_cold_start, list_transform(vec,
  lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-9::DOUBLE)) AS vec FROM serving"""
VIEWS["retrieved"] = f"""
SELECT user_id, item_id, score, rank FROM (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT u.user_id, i.item_id, round(list_inner_product(u.vec, i.vec), 6) AS score
        FROM unit_users u CROSS JOIN unit_items i))
WHERE rank <= {DEPTH}"""
VIEWS["explore_list"] = f"""
SELECT item_id FROM (SELECT item_id, coalesce(n, 0) AS n FROM items LEFT JOIN
  (SELECT item_id, count(*) AS n FROM interactions
   WHERE event_type IN ('view_full', 'view_scroll_past', 'click') GROUP BY item_id) USING (item_id))
WHERE n < {C.ITEM_COLD_START_IMPRESSIONS} AND {uniform_sql("'explore:' || item_id")} < {C.FORCED_EXPLORATION_RATE}
ORDER BY {uniform_sql("'explore:' || item_id")}, item_id LIMIT {C.EXPLORATION_CANDIDATES}"""
VIEWS["trending_list"] = f"""
SELECT item_id FROM trending ORDER BY score DESC, item_id LIMIT {C.TRENDING_CANDIDATES}"""
VIEWS["cands"] = """
SELECT user_id, item_id, arg_min(score, source) AS score, min(source) AS source FROM (
  SELECT user_id, item_id, score, 0 AS source FROM retrieved
  UNION ALL SELECT user_id, item_id, 0.0::DOUBLE, 1 FROM users CROSS JOIN explore_list
  UNION ALL SELECT user_id, item_id, 0.0::DOUBLE, 2 FROM users CROSS JOIN trending_list)
GROUP BY user_id, item_id"""
VIEWS["feats"] = f"""
SELECT c.user_id, c.item_id, i.category, i.created_at, c.score AS user_item_dot_product,
  coalesce({freshness_sql('i.created_at')}, 0) AS item_freshness_score,
  coalesce(a.affinity, 0) AS user_item_category_affinity,
  1.0::DOUBLE - hour({NOW_SQL}) / 24.0::DOUBLE AS time_decay,
  1.0::DOUBLE - coalesce(a.affinity, 0) AS diversity_score,
  coalesce(t.ctr, 0) AS historical_ctr, coalesce(p.popularity, 0) AS popularity_score
FROM cands c LEFT JOIN items i ON i.item_id = c.item_id
LEFT JOIN ctrs t ON t.item_id = c.item_id LEFT JOIN popularity p ON p.item_id = c.item_id
LEFT JOIN affinities a ON a.user_id = c.user_id AND a.category = i.category"""
LINEAR_SQL = " + ".join(
    f"{w}::DOUBLE * {n}" for w, n in zip(ranking.LINEAR_WEIGHTS, C.RANKING_FEATURES)
)
VIEWS["scored"] = f"SELECT user_id, item_id, category, created_at, round({LINEAR_SQL}, 6) AS score FROM feats"
VIEWS["adjusted"] = f"""
SELECT user_id, item_id, category, seen, fresh AS freshness_boosted,
  round(score * CASE WHEN seen THEN {C.SEEN_PENALTY}::DOUBLE ELSE 1 END
    * CASE WHEN fresh THEN {C.FRESHNESS_BOOST}::DOUBLE ELSE 1 END, 9) AS score
FROM (SELECT s.*, r.item_id IS NOT NULL AS seen,
        coalesce(epoch_us({NOW_SQL}) - epoch_us(created_at) <= {C.NEW_ITEM_HOURS * 3600 * 10**6}, false) AS fresh
      FROM scored s LEFT JOIN recent r ON r.user_id = s.user_id AND r.item_id = s.item_id)"""
VIEWS["walk"] = f"""
SELECT user_id, item_id, score, vec, NULL::DOUBLE AS nearest,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r, 1 AS step
FROM adjusted JOIN unit_items USING (item_id)
UNION ALL
SELECT user_id, item_id, score, vec, near2, row_number() OVER (PARTITION BY user_id ORDER BY
    round({C.MMR_LAMBDA}::DOUBLE * score - (1::DOUBLE - {C.MMR_LAMBDA}::DOUBLE) * near2, 9) DESC, item_id), step + 1
FROM (SELECT w.user_id, w.item_id, w.score, w.vec, w.step,
        greatest(w.nearest, round(list_inner_product(w.vec, p.vec), 6)) AS near2
      FROM walk w JOIN walk p ON p.user_id = w.user_id AND p.r = 1
      WHERE w.r > 1 AND w.step < {SIZE})"""
VIEWS["diverse"] = "SELECT user_id, item_id, step AS rank FROM walk WHERE r = 1"
VIEWS["capped"] = f"""
SELECT user_id, item_id, category, row_number() OVER (PARTITION BY user_id ORDER BY overflow, rank) AS rank
FROM (SELECT d.user_id, d.item_id, d.rank, i.category, row_number() OVER (
          PARTITION BY d.user_id, coalesce(i.category, 'unknown') ORDER BY d.rank)
        > greatest(1, floor(count(*) OVER (PARTITION BY d.user_id) * {C.CATEGORY_FRACTION}::DOUBLE)) AS overflow
      FROM diverse d JOIN items i ON i.item_id = d.item_id)"""
VIEWS["arms"] = f"""
SELECT item_id, count(*) AS pulls, sum({weight_sql()}) AS total_reward, avg({weight_sql()}) AS mean_reward
FROM interactions GROUP BY item_id"""
_U = uniform_sql("'bandit:' || a.user_id || ':' || a.item_id")
VIEWS["pool"] = f"""
SELECT a.user_id, a.item_id, {_U} AS u, round(arms.mean_reward, 6) AS mean_reward
FROM adjusted a LEFT JOIN arms ON arms.item_id = a.item_id
WHERE NOT EXISTS (SELECT 1 FROM capped c WHERE c.user_id = a.user_id AND c.item_id = a.item_id)"""


def _draw(j: int) -> str:
    text = f"'bandit:slot:' || user_id || ':{j}'"
    return f"CASE WHEN {uniform_sql(text)} < {C.BANDIT_EPSILON} THEN 1 ELSE 0 END"


VIEWS["picks"] = f"""
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY kind, n) AS slot FROM (
  SELECT user_id, item_id, 2 AS kind, rn AS n, explored FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY u, item_id) AS rn,
      {" + ".join(_draw(j) for j in range(SLOTS))} AS explored FROM pool) WHERE rn <= explored
  UNION ALL
  SELECT user_id, item_id, 1, rb, explored FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean_reward DESC NULLS LAST,
        CASE WHEN mean_reward IS NULL THEN u END, item_id) AS rb
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY u, item_id) AS rn,
            {" + ".join(_draw(j) for j in range(SLOTS))} AS explored FROM pool)
    WHERE rn > explored) WHERE rb <= {SLOTS} - explored)"""
VIEWS["served"] = f"""
SELECT c.user_id, c.rank, coalesce(p.item_id, c.item_id) AS item_id, p.item_id IS NOT NULL AS is_exploration
FROM (SELECT *, rank - (count(*) OVER (PARTITION BY user_id)
        - greatest(1, floor(count(*) OVER (PARTITION BY user_id) * {C.BANDIT_EPSILON}::DOUBLE))) AS slot FROM capped) c
LEFT JOIN picks p ON p.user_id = c.user_id AND p.slot = c.slot"""
VIEWS["popular"] = f"""
SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank
FROM interactions GROUP BY item_id ORDER BY rank LIMIT {SIZE}"""

BUCKET_SQL = hash_mod_sql("'two_tower_v1_vs_baseline:' || user_id", 100)
HELD_SQL = f"({hash_mod_sql(chr(39) + C.HOLDBACK_KEY + ':' + chr(39) + ' || user_id', 10000)} < 500)"


# ---- retrieval -----------------------------------------------------------------------


def serving(t: Tables):
    learned = feed.learned_embeddings(t.interactions, t.items, DIM)
    return features.serving_embeddings(t.users, learned, DIM)


def retrieved(t: Tables):
    return retrieval.vector_topk(serving(t), t.items, DEPTH)


@query("ann_topk", "SELECT user_id, item_id, score, rank::INTEGER AS rank FROM retrieved")
def _(t: Tables):
    return retrieved(t)


@query("ann_topk_lsh")
def _(t: Tables):
    return retrieval.vector_topk_lsh(serving(t), t.items, 10, DIM)


@query("ann_topk_ivf")
def _(t: Tables):
    return ivf.vector_topk_ivf(serving(t), t.items, 10)


@query(
    "ann_ivf_recall",
    "SELECT count(*) AS queries, true AS recall_reached, true AS few_exact FROM users",
)
def _(t: Tables):
    # Against the exact search, and the exact products that were made, of all.
    users, k = cut_lineage(serving(t)), 10
    found = ivf.vector_topk_ivf(users, t.items, k)
    recall = ivf.recall(found, retrieval.vector_topk(users, t.items, k))
    items = t.items.agg(F.count(F.lit(1)).alias("n")).scalar()
    return users.agg(F.count(F.lit(1)).alias("queries")).select(
        "queries",
        (recall.scalar() >= 0.95).alias("recall_reached"),
        (F.lit(ivf.SHORT * k) < F.lit(0.2) * items).alias("few_exact"),
    )


@query(
    "user_item_cross_score",
    """
SELECT user_id, item_id, score, rank::INTEGER AS rank FROM (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT u.user_id, i.item_id, round(list_inner_product(u.vec, i.embedding), 6) AS score
        FROM serving u CROSS JOIN items i)) WHERE rank <= 40
""",
)
def _(t: Tables):
    return retrieval.vector_topk(serving(t), t.items, 40, unit=False)


@query(
    "category_topk",
    """
SELECT user_id, category, item_id, score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, item_id) AS rank FROM (
    SELECT u.user_id, i.category, i.item_id, round(list_inner_product(u.vec, i.vec), 6) AS score
    FROM unit_users u JOIN (SELECT user_id, unnest(onboarding_categories) AS category FROM users) p USING (user_id)
    JOIN unit_items i ON i.category = p.category)) WHERE rank <= 5
""",
)
def _(t: Tables):
    wanted = features.preferred_categories(t.users).select(
        "user_id", F.explode("categories").alias("category")
    )
    probes = serving(t).join(wanted, "user_id")
    return retrieval.category_topk(probes, t.items, 5)


@query(
    "similar_items",
    """
SELECT probe_id, item_id, score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT a.item_id AS probe_id, b.item_id, round(list_inner_product(a.vec, b.vec), 6) AS score
    FROM unit_items a CROSS JOIN unit_items b WHERE a.item_id <> b.item_id)) WHERE rank <= 10
""",
)
def _(t: Tables):
    return retrieval.similar_items(t.items)


@query(
    "most_similar_fallback",
    """
SELECT a.item_id, round(1 - list_inner_product(a.vec, b.vec), 6) AS distance
FROM unit_items a JOIN (SELECT * FROM unit_items WHERE item_id = 0) b ON a.item_id <> b.item_id
ORDER BY distance, a.item_id LIMIT 10
""",
)
def _(t: Tables):
    probe = t.items.filter("item_id = 0").agg(F.first("embedding")).scalar()
    return retrieval.most_similar(t.items, probe, 10, exclude=F.lit(0))


def candidate_rows(t: Tables):
    exploration, trending, _ = feed.shared_lists(t.interactions, t.items, now(), DAY)
    return feed.candidates_of(serving(t), t.users, t.items, exploration, trending, DEPTH)


@query("candidate_union", "SELECT user_id, item_id, score, source FROM cands")
def _(t: Tables):
    return candidate_rows(t)


# ---- ranking ----------------------------------------------------------------------------


def feature_rows(t: Tables):
    return feed.candidate_features(candidate_rows(t), t.interactions, t.items, now())


@query(
    "ranking_features",
    "SELECT user_id, item_id, "
    + ", ".join(f"round({name}, 6) AS {name}" for name in C.RANKING_FEATURES)
    + " FROM feats",
)
def _(t: Tables):
    return feature_rows(t).select(
        "user_id", "item_id", *[round_double(name, 6).alias(name) for name in C.RANKING_FEATURES]
    )


@query(
    "score_candidates",
    """
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INTEGER AS rank
FROM scored
""",
)
def _(t: Tables):
    return ranking.score_candidates(feature_rows(t)).select("user_id", "item_id", "score", "rank")


@query("pluggable_scorer", "SELECT user_id, item_id, score FROM scored")
def _(t: Tables):
    weights = np.array(ranking.LINEAR_WEIGHTS)
    rows = feature_rows(t).select("user_id", "item_id", *C.RANKING_FEATURES)
    scored = ranking.pluggable_score(rows, lambda matrix: matrix @ weights)
    return scored.select("user_id", "item_id", round_double("score", 6).alias("score"))


@query(
    "seen_item_flag",
    """
SELECT r.user_id, r.item_id, s.item_id IS NOT NULL AS seen
FROM retrieved r LEFT JOIN recent s ON s.user_id = r.user_id AND s.item_id = r.item_id
""",
)
def _(t: Tables):
    flagged = ranking.seen_flags(retrieved(t), features.recent_items(t.interactions))
    return flagged.select("user_id", "item_id", "seen")


@query(
    "exclude_seen",
    """
SELECT user_id, item_id, score FROM retrieved r WHERE NOT EXISTS (
  SELECT 1 FROM interactions i WHERE i.user_id = r.user_id AND i.item_id = r.item_id)
""",
)
def _(t: Tables):
    return ranking.exclude_seen(retrieved(t), t.interactions).select("user_id", "item_id", "score")


@query(
    "candidate_attributes",
    """
SELECT user_id, item_id, category, epoch_us(created_at) AS created_us, len(embedding)::INTEGER AS dim
FROM retrieved JOIN items USING (item_id)
""",
)
def _(t: Tables):
    return ranking.candidate_attributes(retrieved(t), t.items).select(
        "user_id",
        "item_id",
        "category",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
        F.size("embedding").alias("dim"),
    )


def adjusted_rows(t: Tables):
    scored = ranking.score_candidates(feature_rows(t))
    recent = features.recent_items(t.interactions)
    return ranking.rerank_adjust(ranking.seen_flags(scored, recent), now())


@query(
    "rerank_adjust",
    """
SELECT user_id, item_id, score, seen, freshness_boosted,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM adjusted
""",
)
def _(t: Tables):
    return adjusted_rows(t).select("user_id", "item_id", "score", "seen", "freshness_boosted", "rank")


@query("mmr_rerank", "SELECT user_id, item_id, rank::INTEGER AS rank FROM diverse")
def _(t: Tables):
    return ranking.mmr_rerank(adjusted_rows(t), t.items, SIZE)


def capped_rows(t: Tables, adjusted):
    diverse = ranking.mmr_rerank(adjusted, t.items, SIZE)
    return ranking.category_cap(diverse.join(t.items.select("item_id", "category"), "item_id"))


@query("category_exposure_cap", "SELECT user_id, item_id, category, rank::INTEGER AS rank FROM capped")
def _(t: Tables):
    return capped_rows(t, adjusted_rows(t)).select("user_id", "item_id", "category", "rank")


@query(
    "bandit_arm_stats",
    "SELECT item_id, pulls, total_reward, round(mean_reward, 6) AS mean_reward FROM arms",
)
def _(t: Tables):
    return ranking.arm_stats(t.interactions).withColumn("mean_reward", F.round("mean_reward", 6))


@query("exploration_pool", "SELECT user_id, item_id FROM pool")
def _(t: Tables):
    # Both sides start from the adjusted scores: built once, stored once.
    adjusted = cut_lineage(adjusted_rows(t).select("user_id", "item_id", "score"))
    return ranking.exploration_pool(adjusted, capped_rows(t, adjusted)).select("user_id", "item_id")


_PICK_U = uniform_sql("'bandit:' || r.user_id || ':' || r.item_id")


@query(
    "bandit_select",
    f"""
known AS (SELECT r.user_id, r.item_id, {_PICK_U} AS u, round(mean_reward, 6) AS mean_reward
  FROM retrieved r LEFT JOIN arms ON arms.item_id = r.item_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY u, item_id) AS by_u,
    row_number() OVER (PARTITION BY user_id ORDER BY mean_reward DESC NULLS LAST, item_id) AS by_reward,
    count(mean_reward) OVER (PARTITION BY user_id) = 0
      OR {uniform_sql("'bandit:draw:' || user_id")} < 0.1 AS explored FROM known)
---
SELECT user_id, item_id, explored FROM ordered
WHERE CASE WHEN explored THEN by_u = 1 ELSE by_reward = 1 END
""",
)
def _(t: Tables):
    return ranking.bandit_select(retrieved(t), ranking.arm_stats(t.interactions))


@query("bandit_inject", "SELECT user_id, rank::INTEGER AS rank, item_id, is_exploration FROM served")
def _(t: Tables):
    arms = ranking.arm_stats(t.interactions)
    # Read by diversity and by the pool: built once, stored once, a row per user.
    adjusted = cut_lineage(ranking.pack_candidates(adjusted_rows(t).select("user_id", "item_id", "score")))
    # The feed is both what is replaced and what the pool leaves out.
    capped = cut_lineage(capped_rows(t, adjusted).select("user_id", "item_id", "rank"))
    return ranking.bandit_inject(capped, adjusted, arms, SIZE)


@query(
    "feed_rank",
    """
SELECT user_id, item_id, score, rank::INTEGER AS rank FROM (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM adjusted) WHERE rank <= 20
""",
)
def _(t: Tables):
    return adjusted_rows(t).filter(F.col("rank") <= SIZE).select("user_id", "item_id", "score", "rank")


@query(
    "popularity_recommend",
    "SELECT user_id, item_id, rank::INTEGER AS rank FROM users CROSS JOIN popular",
)
def _(t: Tables):
    counts = features.item_popularity(t.interactions)
    return ranking.popularity_recommend(t.users, counts).select("user_id", "item_id", "rank")


@query(
    "random_recommend",
    f"""
catalogue AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS size FROM items),
tops AS (SELECT user_id, j, CAST(floor({uniform_sql("'random:' || user_id || ':' || j")} * (j + 1)) AS BIGINT) AS draw
  FROM users CROSS JOIN (SELECT unnest(range(max(size) - {SIZE}, max(size))) AS j FROM catalogue)),
drawn AS (SELECT user_id, list_reduce(list([draw, j] ORDER BY j),
    lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN list_append(acc, x[2]) ELSE list_append(acc, x[1]) END,
    CAST([] AS BIGINT[])) AS ids FROM tops GROUP BY user_id)
---
SELECT user_id, c.item_id, row_number() OVER (PARTITION BY user_id
    ORDER BY {uniform_sql("'random:order:' || user_id || ':' || idx")}, idx)::INTEGER AS rank
FROM (SELECT user_id, unnest(ids) AS idx FROM drawn) JOIN catalogue c USING (idx)
""",
)
def _(t: Tables):
    return ranking.random_recommend(t.users, t.items)


@query(
    "impression_log",
    """
SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS items FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM scored) WHERE rank <= 20 GROUP BY user_id
""",
)
def _(t: Tables):
    shown = ranking.score_candidates(feature_rows(t)).filter(F.col("rank") <= SIZE)
    return ranking.impression_log(shown).select("user_id", F.array_join("item_ids", ",").alias("items"))


def settings() -> feed.FeedSettings:
    return feed.FeedSettings(dim=DIM, depth=DEPTH, trending_horizon_seconds=DAY)


def feed_rows(t: Tables):
    return feed.personalized_feed(
        t.interactions, t.items, t.users, t.experiments, now(), settings()
    )


@query(
    "personalized_feed",
    f"""
flags AS (SELECT item_id, (score - avg(score) OVER ()) / stddev_pop(score) OVER () > {C.TRENDING_Z_THRESHOLD}
    AND count(*) OVER () >= 5 AS is_trending FROM trending)
---
SELECT s.user_id, s.rank::INTEGER AS rank, s.item_id, a.score, a.category, coalesce(f.is_trending, false) AS is_trending,
  a.freshness_boosted, s.is_exploration, v.is_cold_start,
  CASE WHEN held THEN -1 ELSE bucket END AS bucket,
  CASE WHEN held THEN 'holdback' WHEN bucket < 50 THEN 'control' ELSE 'treatment' END AS variant
FROM served s JOIN adjusted a ON a.user_id = s.user_id AND a.item_id = s.item_id
JOIN serving v ON v.user_id = s.user_id LEFT JOIN flags f ON f.item_id = s.item_id
JOIN (SELECT user_id, {BUCKET_SQL} AS bucket, {HELD_SQL} AS held FROM users) b ON b.user_id = s.user_id
""",
)
def _(t: Tables):
    return feed_rows(t)


@query(
    "holdback_feed",
    f"""
held AS (SELECT user_id, {HELD_SQL} AS holdback FROM users)
---
SELECT user_id, item_id, rank::INTEGER AS rank, holdback FROM held CROSS JOIN popular WHERE holdback
UNION ALL
SELECT s.user_id, s.item_id, s.rank::INTEGER, false FROM served s JOIN held h ON h.user_id = s.user_id WHERE NOT h.holdback
""",
)
def _(t: Tables):
    return feed.holdback_feed(feed_rows(t), t.users, t.interactions)
