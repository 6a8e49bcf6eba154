"""Training data, baselines, offline evaluation and attribution."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions.rounding import round_double
from lodestar.operators import evaluation as V
from lodestar.operators import explain, features, ranking, retrieval, training, tree_shap
from lodestar.plans import feed
from lodestar.plans.feature_queries import DIM, rounded, rounded_sql
from lodestar.plans.ranking_queries import feature_rows, serving
from lodestar.plans.registry import query
from lodestar.plans.views import HOLDOUT_SQL, VIEWS, freshness_sql, sql_list, uniform_sql, weight_sql
from lodestar.sources import event_log
from lodestar.sources.bindings import Tables, holdout_start, now
from lodestar.sources.storage import cut_lineage, new_path

LIST_SIZE = 20

VIEWS["catalogue"] = "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS size FROM items"
VIEWS["clicks"] = "SELECT event_id, user_id, item_id, device, created_at FROM interactions WHERE event_type = 'click'"
VIEWS["negatives"] = f"""
SELECT event_id, user_id, j, c.item_id FROM (
  SELECT event_id, user_id, j, draw + CASE WHEN draw >= idx THEN 1 ELSE 0 END AS idx FROM (
    SELECT p.event_id, p.user_id, j, o.idx,
      CAST(floor({uniform_sql("'negative:' || p.event_id || ':' || j")} * (o.size - 1)) AS BIGINT) AS draw
    FROM clicks p JOIN catalogue o ON o.item_id = p.item_id CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS j)))
JOIN catalogue c USING (idx)"""
VIEWS["not_clicked"] = "SELECT user_id, day, item_id FROM impressions WHERE clicked = 0"
VIEWS["logits"] = """
SELECT event_id, user_id, j, item_id, list_inner_product(s.vec, i.embedding) AS logit
FROM (SELECT event_id, user_id, 0 AS j, item_id FROM clicks
      UNION ALL SELECT event_id, user_id, j, item_id FROM negatives)
JOIN serving s USING (user_id) JOIN items i USING (item_id)"""
VIEWS["losses"] = """
SELECT event_id, user_id, max(logit) + ln(sum(exp(logit - top))) AS lse, max(logit) FILTER (j = 0) AS positive
FROM (SELECT *, max(logit) OVER (PARTITION BY event_id, user_id) AS top FROM logits) GROUP BY event_id, user_id"""
VIEWS["train_popular"] = f"""
SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank
FROM interactions WHERE created_at < {HOLDOUT_SQL} GROUP BY item_id ORDER BY rank LIMIT {LIST_SIZE}"""
VIEWS["train_vectors"] = f"""
SELECT user_id, list(x / (sqrt(ss) + 1e-9::DOUBLE) ORDER BY pos) AS vec FROM (
  SELECT user_id, pos, x, sum(x * x) OVER (PARTITION BY user_id) AS ss FROM (
    SELECT user_id, pos, sum(embedding[pos] * w) / sum(n) AS x FROM (
      SELECT i.user_id, it.embedding, i.w, i.n, unnest(range(1, {DIM + 1})) AS pos
      FROM (SELECT user_id, item_id, sum({weight_sql()}) AS w, count(*) AS n
            FROM interactions WHERE created_at < {HOLDOUT_SQL} GROUP BY user_id, item_id) i
      JOIN items it USING (item_id))
    GROUP BY user_id, pos))
GROUP BY user_id"""
VIEWS["vector_lists"] = f"""
SELECT user_id, item_id, rank FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT u.user_id, i.item_id, round(list_inner_product(u.vec, i.vec), 6) AS score
        FROM (SELECT user_id, list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-9::DOUBLE)) AS vec
              FROM train_vectors) u CROSS JOIN unit_items i)) WHERE rank <= {LIST_SIZE}"""
VIEWS["random_tops"] = f"""
SELECT user_id, j, CAST(floor({uniform_sql("'random:' || user_id || ':' || j")} * (j + 1)) AS BIGINT) AS draw
FROM users CROSS JOIN (SELECT unnest(range(max(size) - {LIST_SIZE}, max(size))) AS j FROM catalogue)"""
VIEWS["random_lists"] = f"""
SELECT user_id, c.item_id, row_number() OVER (PARTITION BY user_id
    ORDER BY {uniform_sql("'random:order:' || user_id || ':' || idx")}, idx) AS rank
FROM (SELECT user_id, unnest(list_reduce(list([draw, j] ORDER BY j),
    lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN list_append(acc, x[2]) ELSE list_append(acc, x[1]) END,
    CAST([] AS BIGINT[]))) AS idx FROM random_tops GROUP BY user_id) JOIN catalogue c USING (idx)"""
VIEWS["held_out"] = f"""
SELECT DISTINCT user_id, item_id FROM interactions WHERE created_at >= {HOLDOUT_SQL} AND {weight_sql()} > 0"""
VIEWS["outcomes"] = f"""
SELECT user_id, item_id, count(*) FILTER (event_type = 'click') AS clicks, coalesce(sum(dwell_ms), 0)::BIGINT AS dwell_ms
FROM interactions WHERE created_at >= {HOLDOUT_SQL} GROUP BY user_id, item_id"""
VIEWS["lists"] = """
SELECT a.approach, a.user_id, a.item_id, a.rank, CASE WHEN h.user_id IS NULL THEN 0 ELSE 1 END AS relevance
FROM (SELECT 'two_tower' AS approach, user_id, item_id, rank FROM vector_lists
  UNION ALL SELECT 'most_popular', user_id, item_id, rank FROM users CROSS JOIN train_popular
  UNION ALL SELECT 'random', user_id, item_id, rank FROM random_lists) a
LEFT JOIN held_out h ON h.user_id = a.user_id AND h.item_id = a.item_id"""
VIEWS["aucs"] = """
SELECT approach, (sum(r) FILTER (relevance = 1) - n1::DOUBLE * (n1 + 1) / 2) / (n1::DOUBLE * n0) AS auc FROM (
  SELECT approach, relevance, rank() OVER (PARTITION BY approach ORDER BY s)
      + (count(*) OVER (PARTITION BY approach, s) - 1) / 2.0::DOUBLE AS r,
    sum(relevance) OVER (PARTITION BY approach) AS n1, sum(1 - relevance) OVER (PARTITION BY approach) AS n0
  FROM (SELECT approach, relevance, 1.0::DOUBLE / rank AS s FROM lists)) GROUP BY approach, n1, n0"""
VIEWS["ndcgs"] = """
SELECT approach, avg(coalesce(dcg / nullif(idcg, 0), 0)) AS ndcg FROM (
  SELECT approach, user_id, sum(relevance / log2(rank + 1)) FILTER (rank <= 10) AS dcg,
    sum(relevance / log2(ideal + 1)) FILTER (ideal <= 10) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY approach, user_id ORDER BY relevance DESC) AS ideal FROM lists)
  GROUP BY approach, user_id) GROUP BY approach"""
VIEWS["mrrs"] = """
SELECT approach, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM (
  SELECT approach, user_id, min(rank) FILTER (relevance > 0) AS first FROM lists GROUP BY approach, user_id)
GROUP BY approach"""
VIEWS["coverages"] = """
SELECT approach, count(DISTINCT item_id) / (SELECT count(*) FROM items)::DOUBLE AS coverage FROM lists GROUP BY approach"""
VIEWS["spreads"] = f"""
SELECT approach, user_id, 1 - (sum(x * x) - max(own)) / (max(n) * (max(n) - 1)) AS diversity FROM (
  SELECT approach, user_id, pos, sum(vec[pos]) AS x, count(*) AS n, sum(own) AS own FROM (
    SELECT approach, user_id, vec, list_inner_product(vec, vec) AS own, unnest(range(1, {DIM + 1})) AS pos
    FROM lists JOIN unit_items USING (item_id)) GROUP BY approach, user_id, pos)
GROUP BY approach, user_id"""
VIEWS["summary"] = f"""
SELECT approach, clicks, impressions, clicks / impressions::DOUBLE AS ctr, dwell / impressions::DOUBLE AS avg_dwell_ms,
  returning_users / users::DOUBLE AS return_rate, diversity
FROM (SELECT approach, sum(c)::BIGINT AS clicks, sum(n)::BIGINT AS impressions, sum(d) AS dwell,
        count(*) FILTER (c > 0) AS returning_users, count(*) AS users
      FROM (SELECT approach, l.user_id, count(*) AS n, sum(CASE WHEN clicks > 0 THEN 1 ELSE 0 END) AS c,
              sum(coalesce(dwell_ms, 0)) AS d
            FROM lists l LEFT JOIN outcomes o ON o.user_id = l.user_id AND o.item_id = l.item_id
            GROUP BY approach, l.user_id) GROUP BY approach)
JOIN (SELECT approach, 1 - (sum(x * x) - max(own)) / (max(n)::DOUBLE * (max(n) - 1)) AS diversity FROM (
        SELECT approach, pos, sum(vec[pos]) AS x, count(*) AS n, sum(own) AS own FROM (
          SELECT approach, vec, list_inner_product(vec, vec) AS own, unnest(range(1, {DIM + 1})) AS pos
          FROM lists JOIN unit_items USING (item_id)) GROUP BY approach, pos) GROUP BY approach) USING (approach)"""


# ---- training data -----------------------------------------------------------------------


def clicks(t: Tables):
    clicked = t.interactions.filter("event_type = 'click'")
    return clicked.select(
        "event_id", "user_id", "item_id", "device", "created_at", F.to_date("created_at").alias("day")
    )


def uniform(t: Tables):
    return training.uniform_negatives(clicks(t), t.items)


@query("uniform_negatives", "SELECT event_id, j::INTEGER AS j, item_id FROM negatives")
def _(t: Tables):
    return uniform(t).select("event_id", "j", "item_id")


@query("shown_not_clicked", "SELECT user_id, day::VARCHAR AS day, item_id FROM not_clicked")
def _(t: Tables):
    rows = training.shown_not_clicked(t.impressions)
    return rows.withColumn("day", F.col("day").cast("string"))


@query(
    "shown_negatives",
    f"""
placed AS (SELECT user_id, day, item_id, row_number() OVER (PARTITION BY user_id, day
    ORDER BY {uniform_sql("'shown:' || user_id || ':' || day || ':' || item_id")}, item_id) AS position FROM not_clicked),
sized AS (SELECT p.event_id, p.user_id, created_at::DATE AS day, coalesce(s.size, 0) AS size, j
  FROM clicks p LEFT JOIN (SELECT user_id, day, count(*) AS size FROM not_clicked GROUP BY user_id, day) s
    ON s.user_id = p.user_id AND s.day = p.created_at::DATE CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS j))
---
SELECT z.event_id, z.j::INTEGER AS j, b.item_id, 'shown' AS source FROM sized z JOIN placed b
  ON b.user_id = z.user_id AND b.day = z.day AND b.position
    = (CAST(floor({uniform_sql("'shown:start:' || z.event_id")} * z.size) AS BIGINT) + z.j - 1) % z.size + 1
WHERE z.j <= z.size
UNION ALL
SELECT z.event_id, z.j, n.item_id, 'uniform' FROM sized z JOIN negatives n ON n.event_id = z.event_id AND n.j = z.j
WHERE z.j > z.size
""",
)
def _(t: Tables):
    rows = training.shown_negatives(clicks(t), t.impressions, t.items)
    return rows.select("event_id", "j", "item_id", "source")


@query(
    "training_examples",
    f"""
picked AS (SELECT r.event_id, r.j, r.user_id, r.item_id, p.device, p.created_at, CAST(p.created_at AS DATE) AS day
  FROM (SELECT event_id, user_id, 0 AS j, item_id FROM clicks
      UNION ALL SELECT event_id, user_id, j, item_id FROM negatives) r JOIN clicks p ON p.event_id = r.event_id)
---
SELECT r.event_id, r.j::INTEGER AS j, r.user_id, r.item_id, CASE WHEN r.j = 0 THEN 1 ELSE 0 END AS label,
  CAST(list_position({sql_list(C.CATEGORIES)}, i.category) - 1 AS INTEGER) AS category_id,
  round({freshness_sql('i.created_at', 'r.created_at')}, 6) AS freshness_score, round(coalesce(c.ctr, 0), 6) AS historical_ctr,
  CAST(list_position({sql_list(C.DEVICES)}, r.device) - 1 AS INTEGER) AS device_id,
  CAST(hour(r.created_at) AS INTEGER) AS time_of_day, array_to_string(s.seq, ',') AS recent_item_sequence
FROM picked r JOIN items i ON i.item_id = r.item_id JOIN sequences s ON s.event_id = r.event_id
ASOF LEFT JOIN ctr_through c ON c.item_id = r.item_id AND r.day > c.day
""",
)
def _(t: Tables):
    rows = training.training_examples(
        clicks(t), uniform(t), t.items, t.interactions
    )
    return rows.withColumns(
        {
            "freshness_score": F.round("freshness_score", 6),
            "historical_ctr": F.round("historical_ctr", 6),
            "recent_item_sequence": F.array_join("recent_item_sequence", ","),
        }
    )


@query(
    "scan_training_frame",
    f"""
SELECT i.user_id, i.item_id,
  CAST(list_position({sql_list(C.CATEGORIES)}, t.category) - 1 AS INTEGER) AS category_id,
  CAST(list_position({sql_list(C.DEVICES)}, i.device) - 1 AS INTEGER) AS device_id,
  CAST(hour(i.created_at) AS INTEGER) AS time_of_day,
  CASE WHEN i.event_type = 'click' THEN 1 ELSE 0 END AS label,
  array_to_string(q.seq, ',') AS recent_item_sequence, len(t.embedding)::INTEGER AS content_dim,
  round(t.embedding[1], 6) AS content_first, round({freshness_sql('t.created_at', 'i.created_at')}, 6) AS freshness_score,
  round(coalesce(c.ctr, 0), 6) AS historical_ctr,
  round(coalesce(list_inner_product(v.vec, t.embedding), 0), 6) AS user_item_dot_product
FROM (SELECT *, CAST(created_at AS DATE) AS day FROM interactions) i JOIN items t ON t.item_id = i.item_id
JOIN sequences q ON q.event_id = i.event_id LEFT JOIN serving v ON v.user_id = i.user_id
ASOF LEFT JOIN ctr_through c ON c.item_id = i.item_id AND i.day > c.day
""",
)
def _(t: Tables):
    frame = features.training_frame(t.interactions, t.items, serving(t))
    path = new_path(t.spark, "training-frame")
    frame.write.parquet(path)
    back = event_log.scan_training_frame(t.spark, path)
    return back.select(
        "user_id",
        "item_id",
        "category_id",
        "device_id",
        "time_of_day",
        "label",
        F.array_join("recent_item_sequence", ",").alias("recent_item_sequence"),
        F.size("content_embedding").alias("content_dim"),
        F.round(F.col("content_embedding")[0].cast("double"), 6).alias("content_first"),
        *[F.round(c, 6).alias(c) for c in ("freshness_score", "historical_ctr", "user_item_dot_product")],
    )


_SPLIT_U = uniform_sql("'split:' || event_id")


@query(
    "train_val_split",
    f"""
SELECT event_id, {_SPLIT_U} < 0.1 OR {_SPLIT_U} = (SELECT min({_SPLIT_U}) FROM events) AS is_validation FROM events
""",
)
def _(t: Tables):
    return training.train_val_split(t.raw("events"), "event_id").select("event_id", "is_validation")


@query("sampled_softmax_loss", "SELECT count(*) AS examples, round(avg(lse - positive), 6) AS loss FROM losses")
def _(t: Tables):
    loss = training.sampled_softmax_loss(clicks(t), uniform(t), serving(t), t.items)
    return loss.withColumn("loss", F.round("loss", 6))


@query(
    "online_vector_update",
    f"""
coefs AS (SELECT user_id, item_id, sum(exp(logit - lse) - CASE WHEN j = 0 THEN 1 ELSE 0 END) AS c,
    count(*) FILTER (j = 0) AS n FROM logits JOIN losses USING (event_id, user_id) GROUP BY user_id, item_id),
grads AS (SELECT user_id, pos, sum(embedding[pos] * c) AS g, sum(n) AS n FROM (
    SELECT user_id, embedding, c, n, unnest(range(1, {DIM + 1})) AS pos FROM coefs JOIN items USING (item_id))
  GROUP BY user_id, pos),
stepped AS (SELECT user_id, list(vec[pos] - 0.0001::DOUBLE / n * g ORDER BY pos) AS vec
  FROM grads JOIN serving USING (user_id) GROUP BY user_id)
---
SELECT user_id, {rounded_sql('vec', 8)} AS vec FROM stepped
""",
)
def _(t: Tables):
    updated = training.online_vector_update(clicks(t), uniform(t), serving(t), t.items, DIM)
    return updated.select("user_id", rounded(F.col("embedding"), 8).alias("vec"))


# ---- factor models ---------------------------------------------------------------------------


def before_holdout(t: Tables):
    return t.interactions.filter(F.col("created_at") < holdout_start())


@query("cf_svd")
def _(t: Tables):
    pairs = training.click_counts(before_holdout(t))
    users, items = training.cf_svd(pairs)
    return training.recommend_from_factors(users, items, LIST_SIZE, exclude=pairs)


@query("cf_als")
def _(t: Tables):
    pairs = training.click_counts(t.purchases)
    users, items = training.cf_als(pairs)
    return training.recommend_from_factors(users, items, LIST_SIZE)


_LISTS_SQL = """
SELECT user_id, least({size}, (SELECT count(DISTINCT item_id) FROM {pairs}){seen})::BIGINT AS n,
  0::BIGINT AS seen, true AS ranked FROM {pairs} p GROUP BY user_id"""


def list_properties(lists, pairs):
    """Per user of the pairs: length of the list, items of the pairs in it, ranks without gaps."""
    marked = pairs.select("user_id", "item_id").distinct().withColumn("own", F.lit(1))
    joined = lists.join(marked, ["user_id", "item_id"], "left")
    return joined.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count("own").alias("seen"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count("*"))).alias("ranked"),
    )


VIEWS["past_pairs"] = f"""
SELECT DISTINCT user_id, item_id FROM interactions WHERE created_at < {HOLDOUT_SQL} AND {weight_sql()} > 0"""


@query(
    "cf_svd_properties",
    _LISTS_SQL.format(size=LIST_SIZE, pairs="past_pairs", seen=" - count(DISTINCT item_id)"),
)
def _(t: Tables):
    pairs = training.click_counts(before_holdout(t))
    users, items = training.cf_svd(pairs)
    return list_properties(training.recommend_from_factors(users, items, LIST_SIZE, exclude=pairs), pairs)


@query("cf_svd_orthogonality", f"SELECT {C.CF_FACTORS}::BIGINT AS factors, true AS orthonormal, true AS ordered")
def _(t: Tables):
    from lodestar.functions.vectors import vector_sum

    users, items = training.cf_svd(training.click_counts(before_holdout(t)))
    k = C.CF_FACTORS
    gram = training.gram(items.select(F.col("embedding").alias("v")), k)
    sizes = users.select(F.transform("embedding", lambda x: x * x).alias("v")).agg(vector_sum("v", k).alias("s")).first()
    ordered = all(a >= b - 1e-6 for a, b in zip(sizes["s"], sizes["s"][1:]))
    straight = bool(abs(gram - np.eye(k)).max() < 1e-6)
    return t.spark.createDataFrame([(k, straight, ordered)], "factors bigint, orthonormal boolean, ordered boolean")


@query("cf_als_properties", "SELECT DISTINCT user_id, 20::BIGINT AS n, true AS ranked FROM purchases")
def _(t: Tables):
    pairs = training.click_counts(t.purchases)
    users, items = training.cf_als(pairs)
    lists = training.recommend_from_factors(users, items, LIST_SIZE)
    return list_properties(lists, pairs).select("user_id", "n", "ranked")


@query("score_candidates_gbt", "SELECT user_id, count(*) AS n, true AS ranked, true AS bounded FROM feats GROUP BY user_id")
def _(t: Tables):
    model = training.train_ranker(cut_lineage(labelled_features(t)), rounds=ROUNDS)
    scored = ranking.score_candidates(feature_rows(t), model)
    return scored.groupBy("user_id").agg(
        F.count("*").alias("n"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count("*"))).alias("ranked"),
        F.every(F.col("score").between(0.0, 1.0)).alias("bounded"),
    )


@query("tune_factorization")
def _(t: Tables):
    return training.tune_factorization(training.click_counts(t.purchases), [8, 16], [0.05, 0.5])


# ---- evaluation ----------------------------------------------------------------------------------


def ranked_lists(t: Tables):
    past = before_holdout(t)
    vectors = features.user_embeddings(past, t.items, DIM)
    vector = retrieval.vector_topk(vectors, t.items, LIST_SIZE)
    popular = ranking.popularity_recommend(t.users, features.item_popularity(past), LIST_SIZE)
    uniform_lists = ranking.random_recommend(t.users, t.items, LIST_SIZE)
    named = [("two_tower", vector), ("most_popular", popular), ("random", uniform_lists)]
    return union_lists(named)


def union_lists(named):
    parts = [
        df.select(F.lit(name).alias("approach"), "user_id", "item_id", "rank") for name, df in named
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def held_out(t: Tables):
    later = t.interactions.filter(F.col("created_at") >= holdout_start())
    return later.filter(E.signal_weight(F.col("event_type")) > 0)


def outcomes(t: Tables):
    later = t.interactions.filter(F.col("created_at") >= holdout_start())
    return later.groupBy("user_id", "item_id").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.coalesce(F.sum("dwell_ms"), F.lit(0)).alias("dwell_ms"),
    )


def judged(t: Tables):
    return V.mark_relevance(ranked_lists(t), held_out(t))


@query("auc", "SELECT approach, round(auc, 6) AS auc FROM aucs")
def _(t: Tables):
    scored = judged(t).select(
        "approach", (1.0 / F.col("rank")).alias("score"), F.col("relevance").alias("label")
    )
    return V.auc(scored, ["approach"]).withColumn("auc", F.round("auc", 6))


@query("ndcg_at_k", "SELECT approach, round(ndcg, 6) AS ndcg FROM ndcgs")
def _(t: Tables):
    return V.ndcg_at_k(judged(t)).withColumn("ndcg", F.round("ndcg", 6))


@query("mrr", "SELECT approach, round(mrr, 6) AS mrr FROM mrrs")
def _(t: Tables):
    return V.mrr(judged(t)).withColumn("mrr", F.round("mrr", 6))


@query("catalog_coverage", "SELECT approach, round(coverage, 6) AS coverage FROM coverages")
def _(t: Tables):
    return V.catalog_coverage(judged(t), t.items).withColumn("coverage", F.round("coverage", 6))


@query("intra_list_diversity", "SELECT approach, user_id, round(diversity, 6) AS diversity FROM spreads")
def _(t: Tables):
    spread = V.diversity(ranked_lists(t), t.items, ["approach", "user_id"], DIM)
    return spread.withColumn("diversity", F.round("diversity", 6))


@query(
    "evaluation_report",
    """
SELECT approach, round(auc, 6) AS auc, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(coverage, 6) AS coverage,
  round(diversity, 6) AS diversity
FROM aucs JOIN ndcgs USING (approach) JOIN mrrs USING (approach) JOIN coverages USING (approach)
JOIN (SELECT approach, avg(diversity) AS diversity FROM spreads GROUP BY approach) USING (approach)
""",
)
def _(t: Tables):
    report = V.evaluation_report(judged(t), t.items, DIM)
    return report.select(
        "approach", *[F.round(c, 6).alias(c) for c in ("auc", "ndcg", "mrr", "coverage", "diversity")]
    )


_ROUNDED = ["ctr", "avg_dwell_ms", "return_rate", "diversity"]
_SUMMARY_SQL = "SELECT approach, clicks, impressions, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)


def round_summary(summary):
    return summary.select("approach", "clicks", "impressions", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@query("benchmark_summary", _SUMMARY_SQL + " FROM summary")
def _(t: Tables):
    return round_summary(V.replay_summary(ranked_lists(t), outcomes(t), t.items, DIM))


@query(
    "ctr_lift",
    """
SELECT approach, CASE WHEN ctr > 0 THEN round(((SELECT ctr FROM summary WHERE approach = 'two_tower') - ctr) / ctr, 6)
  ELSE 'inf'::DOUBLE END AS lift FROM summary WHERE approach <> 'two_tower'
""",
)
def _(t: Tables):
    summary = V.replay_summary(ranked_lists(t), outcomes(t), t.items, DIM)
    lifts = V.ctr_lift(summary, "two_tower")
    return lifts.withColumn("lift", F.when(F.col("lift") < float("inf"), F.round("lift", 6)).otherwise(F.col("lift")))


@query("baseline_comparison")
def _(t: Tables):
    past = before_holdout(t)
    pairs = training.click_counts(past)
    users, items = training.cf_svd(pairs)
    cf = union_lists([("collaborative_filtering", training.recommend_from_factors(users, items, LIST_SIZE))])
    return V.replay_summary(ranked_lists(t).unionByName(cf), outcomes(t), t.items, DIM)


# ---- ranker and attribution ----------------------------------------------------------------------


def labelled_features(t: Tables):
    """Ranking features of pairs touched in the held-out period; the label says whether they were clicked.

    Features come from the events before that period, so no row sees its label.
    """
    past = before_holdout(t)
    later = t.interactions.filter(F.col("created_at") >= holdout_start())
    touched = later.groupBy("user_id", "item_id").agg(
        F.max((F.col("event_type") == "click").cast("int")).alias("label")
    )
    learned = features.user_embeddings(past, t.items, DIM)
    served = features.serving_embeddings(t.users, learned, DIM)
    vectors = served.select("user_id", F.col("embedding").alias("u"))
    item_vectors = t.items.select("item_id", F.col("embedding").alias("v"))
    from lodestar.functions.vectors import dot

    scored = (
        touched.join(item_vectors, "item_id")
        .join(vectors, "user_id")
        .select("user_id", "item_id", "label", dot(F.col("u"), F.col("v")).alias("score"))
    )
    return feed.candidate_features(scored, past, t.items, holdout_start())


ROUNDS = 50


@query("train_ranker")
def _(t: Tables):
    examples = training.train_val_split(
        cut_lineage(labelled_features(t)).withColumn("pair", F.concat_ws("-", "user_id", "item_id")), "pair"
    )
    model = training.train_ranker(examples.filter("NOT is_validation"), rounds=ROUNDS)
    scored = ranking.ranker_scores(model, examples.filter("is_validation"))
    return V.auc(scored.withColumn("model", F.lit("gbt")), ["model"])


@query("feature_attribution_gbt")
def _(t: Tables):
    examples = cut_lineage(labelled_features(t))
    model = training.train_ranker(examples, rounds=ROUNDS)
    return explain.coalition_attribution(examples, model, ["user_id", "item_id"])


@query("feature_attribution_trees")
def _(t: Tables):
    examples = cut_lineage(labelled_features(t))
    model = training.train_ranker(examples, rounds=ROUNDS)
    return tree_shap.tree_attribution(examples, tree_shap.trees_of(model), ["user_id", "item_id"])


def _fixed_trees() -> list[tree_shap.Tree]:
    """Three small trees over the ranking features; their covers are counted over the rows they explain."""
    dot, fresh, affinity, _, _, ctr, popularity = range(len(C.RANKING_FEATURES))
    Split, Leaf = tree_shap.Split, tree_shap.Leaf
    return [
        Split(dot, 0.2037, Leaf(-0.4), Split(popularity, 0.3011, Leaf(0.1), Leaf(0.6))),
        Split(
            fresh,
            0.0513,
            Split(affinity, 0.1519, Leaf(-0.2), Leaf(0.3)),
            Split(dot, 0.0117, Leaf(0.05), Leaf(0.5)),
        ),
        Split(ctr, 0.2023, Split(dot, 0.3517, Split(dot, 0.1013, Leaf(0.0), Leaf(0.2)), Leaf(0.7)), Leaf(-0.1)),
    ]


def _tree_attribution_sql() -> str:
    """Every Shapley value as the sum over leaves and subsets of the other features on the leaf's path."""
    covers: list[str] = []
    terms: dict[int, list[str]] = {i: [] for i in range(len(C.RANKING_FEATURES))}
    base: list[str] = []

    def visit(tree: tree_shap.Tree, here: list[str], path: dict[int, tuple[list[str], list[str]]]) -> None:
        number = len(covers)
        covers.append(f"count(*) FILTER ({' AND '.join(here) or 'true'})::DOUBLE AS n{number}")
        if isinstance(tree, tree_shap.Split):
            for child, sign in ((tree.left, "<="), (tree.right, ">")):
                test = f"{C.RANKING_FEATURES[tree.feature]} {sign} {tree.threshold}"
                tests, shares = path.get(tree.feature, ([], []))
                share = f"coalesce(n{len(covers)} / nullif(n{number}, 0), 0)"
                visit(child, [*here, test], path | {tree.feature: ([*tests, test], [*shares, share])})
            return
        stays = {f: f"(CASE WHEN {' AND '.join(tests)} THEN 1.0::DOUBLE ELSE 0 END)" for f, (tests, _) in path.items()}
        share = {f: f"({' * '.join(shares)})" for f, (_, shares) in path.items()}
        base.append(" * ".join([f"{tree.value}::DOUBLE", *share.values()]))
        n = len(path)
        for j in path:
            others = [k for k in path if k != j]
            for size in range(n):
                weight = factorial(size) * factorial(n - size - 1) / factorial(n)
                for chosen in combinations(others, size):
                    rest = [stays[k] if k in chosen else share[k] for k in others]
                    terms[j].append(" * ".join([f"{tree.value * weight}::DOUBLE", f"({stays[j]} - {share[j]})", *rest]))

    for tree in _fixed_trees():
        visit(tree, [], {})
    columns = [
        f"round({' + '.join(terms[i]) or '0.0::DOUBLE'}, 6) + 0.0 AS c_{n}" for i, n in enumerate(C.RANKING_FEATURES)
    ]
    return (
        f"covers AS (SELECT {', '.join(covers)} FROM feats)\n---\n"
        f"SELECT user_id, item_id, {', '.join(columns)}, round({' + '.join(base)}, 6) + 0.0 AS base_margin FROM feats, covers"
    )


@query("tree_attribution", _tree_attribution_sql())
def _(t: Tables):
    rows = cut_lineage(feature_rows(t).select("user_id", "item_id", *C.RANKING_FEATURES))
    found = tree_shap.tree_attribution(rows, tree_shap.with_covers(_fixed_trees(), rows), ["user_id", "item_id"])
    names = [*[f"c_{n}" for n in C.RANKING_FEATURES], "base_margin"]
    return found.select("user_id", "item_id", *[(round_double(n, 6) + F.lit(0.0)).alias(n) for n in names])


_WEIGHTS = dict(zip(C.RANKING_FEATURES, ranking.LINEAR_WEIGHTS))
VIEWS["attributed"] = (
    "SELECT user_id, item_id, rank, "
    + ", ".join(f"{w}::DOUBLE * ({n} - avg({n}) OVER ()) AS c_{n}" for n, w in _WEIGHTS.items())
    + " FROM feats JOIN (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)"
    " AS rank FROM scored) USING (user_id, item_id)"
)
VIEWS["strongest"] = (
    "SELECT user_id, item_id, feature, value, row_number() OVER (PARTITION BY user_id, item_id "
    "ORDER BY abs(value) DESC, i) AS pos FROM ("
    + " UNION ALL ".join(
        f"SELECT user_id, item_id, {i} AS i, '{n}' AS feature, c_{n} AS value FROM attributed"
        for i, n in enumerate(C.RANKING_FEATURES)
    )
    + ")"
)

# All features of a row in one sorted list: strongest first, ties in feature order.
VIEWS["top_listed"] = (
    "SELECT user_id, item_id, rank, c_popularity_score, c_user_item_dot_product, list_sort(["
    + ", ".join(
        f"{{'size': -abs(c_{n}), 'i': {i}, 'feature': '{n}'}}" for i, n in enumerate(C.RANKING_FEATURES)
    )
    + "]) AS sorted FROM attributed"
)


def attributed(t: Tables):
    # Read twice, for the means and for the rows, so built once.
    scored = ranking.score_candidates(feature_rows(t)).select("user_id", "item_id", *C.RANKING_FEATURES, "rank")
    return explain.linear_attribution(cut_lineage(scored), ranking.LINEAR_WEIGHTS)


@query(
    "feature_attribution",
    "SELECT user_id, item_id, "
    + ", ".join(f"round(c_{n}, 6) + 0.0 AS c_{n}" for n in C.RANKING_FEATURES)
    + " FROM attributed",
)
def _(t: Tables):
    return attributed(t).select(
        "user_id", "item_id", *[round_double(f"c_{n}", 6).alias(f"c_{n}") for n in C.RANKING_FEATURES]
    )


@query(
    "top_features",
    "SELECT user_id, item_id, string_agg(feature, ',' ORDER BY pos) AS features FROM strongest WHERE pos <= 5 GROUP BY ALL",
)
def _(t: Tables):
    top = explain.top_features(5).getField("feature")
    return attributed(t).select("user_id", "item_id", F.array_join(top, ",").alias("features"))


_TEXT_SQL = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in C.EXPLANATIONS.items())


@query(
    "explanation_text",
    f"SELECT user_id, item_id, CASE feature {_TEXT_SQL} ELSE '{C.DEFAULT_EXPLANATION}' END AS explanation "
    "FROM strongest WHERE pos = 1",
)
def _(t: Tables):
    return attributed(t).select("user_id", "item_id", explain.explanation_text().alias("explanation"))


@query(
    "developer_attribution",
    """
SELECT user_id, item_id, rank::INTEGER AS rank, 'v1' AS model_version, round(c_popularity_score, 6) + 0.0 AS popularity,
  round(c_user_item_dot_product, 6) + 0.0 AS dot,
  array_to_string(list_transform(sorted[1:5], lambda x: x.feature), ',') AS top
FROM top_listed
""",
)
def _(t: Tables):
    record = explain.developer_attribution(attributed(t), "v1")
    return record.select(
        "user_id",
        "item_id",
        "rank",
        "model_version",
        round_double(F.col("feature_contributions")["popularity_score"], 6).alias("popularity"),
        round_double(F.col("feature_contributions")["user_item_dot_product"], 6).alias("dot"),
        F.array_join("top_features.feature", ",").alias("top"),
    )


_TOTAL = " + ".join(f"abs(c_{n})" for n in C.RANKING_FEATURES)


@query(
    "false_attribution_rate",
    f"""
SELECT count(*) AS rows, round(avg(CASE WHEN abs(c_user_item_dot_product) / ({_TOTAL} + 1e-9::DOUBLE) > 0.5
  THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM attributed
""",
)
def _(t: Tables):
    rate = explain.false_attribution_rate(attributed(t), "user_item_dot_product")
    return rate.withColumn("rate", F.round("rate", 6))
