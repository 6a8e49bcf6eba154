"""Experiment assignment, rollups, significance and operational metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.operators import experiments as X
from lodestar.operators import monitoring as M
from lodestar.plans.registry import query
from lodestar.plans.views import IMPRESSION_SQL, VIEWS, erfc_sql, hash_mod_sql
from lodestar.sources.bindings import Tables, now

HELD_SQL = f"({hash_mod_sql(chr(39) + C.HOLDBACK_KEY + ':' + chr(39) + ' || user_id', 10000)} < 500)"
BUCKET_SQL = hash_mod_sql("experiment || ':' || user_id", 100)
VARIANT_SQL = """CASE WHEN bucket >= control_low AND bucket < control_high THEN 'control'
  WHEN bucket >= treatment_low AND bucket < treatment_high THEN 'treatment' ELSE 'unassigned' END"""

VIEWS["shoppers"] = "SELECT c_custkey AS user_id FROM customer"
VIEWS["buckets"] = f"""
SELECT user_id, experiment, {BUCKET_SQL} AS bucket
FROM shoppers CROSS JOIN (SELECT name AS experiment FROM experiments WHERE status = 'active')"""
VIEWS["assignments"] = f"""
SELECT user_id, experiment, CASE WHEN {HELD_SQL} THEN -1 ELSE bucket END AS bucket,
  CASE WHEN {HELD_SQL} THEN 'holdback' ELSE {VARIANT_SQL} END AS variant
FROM buckets JOIN experiments ON name = experiment"""
VIEWS["rollup"] = f"""
SELECT experiment, variant, count(*) FILTER ({IMPRESSION_SQL}) AS impressions,
  count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type IN ('share', 'save')) AS shares,
  coalesce(sum(dwell_ms) FILTER (event_type = 'dwell'), 0)::BIGINT AS dwell_ms_total
FROM interactions JOIN assignments USING (user_id) GROUP BY experiment, variant"""
VIEWS["two_arms"] = """
SELECT experiment, coalesce(sum(clicks) FILTER (variant = 'control'), 0)::DOUBLE AS x1,
  coalesce(sum(impressions) FILTER (variant = 'control'), 0)::DOUBLE AS n1,
  coalesce(sum(clicks) FILTER (variant = 'treatment'), 0)::DOUBLE AS x2,
  coalesce(sum(impressions) FILTER (variant = 'treatment'), 0)::DOUBLE AS n2
FROM rollup GROUP BY experiment"""
VIEWS["ztests"] = f"""
SELECT experiment, x1, n1, x2, n2, z, CASE WHEN z = 0 THEN 1.0::DOUBLE
  ELSE {erfc_sql('abs(z) / 1.4142135623730951::DOUBLE')} END AS p
FROM (SELECT *, coalesce((x2 / nullif(n2, 0) - x1 / nullif(n1, 0)) / nullif(sqrt(((x1 + x2) / nullif(n1 + n2, 0))
    * (1 - (x1 + x2) / nullif(n1 + n2, 0)) * (1 / nullif(n1, 0) + 1 / nullif(n2, 0))), 0), 0) AS z FROM two_arms)"""
VIEWS["srm"] = f"""
SELECT experiment, chi2, {erfc_sql('sqrt(chi2 / 2.0::DOUBLE)')} AS p
FROM (SELECT experiment, coalesce(pow(n1 - e1, 2) / nullif(e1, 0) + pow(n2 - (n1 + n2 - e1), 2) / nullif(n1 + n2 - e1, 0), 0) AS chi2
  FROM (SELECT *, (n1 + n2) * (ratio / (ratio + 1.0::DOUBLE)) AS e1 FROM two_arms JOIN
    (SELECT name AS experiment, (control_high - control_low)::DOUBLE / (treatment_high - treatment_low) AS ratio
     FROM experiments) USING (experiment)))"""


def shoppers(t: Tables):
    return t.raw("customer").select(F.col("c_custkey").alias("user_id"))


def assignments(t: Tables):
    return X.assign(X.requests_for_active(shoppers(t), t.experiments), t.experiments)


def rollup(t: Tables):
    return X.experiment_rollup(t.interactions, assignments(t))


@query("experiment_bucket", "SELECT user_id, experiment, bucket FROM buckets")
def _(t: Tables):
    requests = X.requests_for_active(shoppers(t), t.experiments)
    number = X.bucket(F.col("experiment"), F.col("user_id"))
    return requests.select("user_id", "experiment", number.alias("bucket"))


@query("holdback_flag", f"SELECT user_id, {HELD_SQL} AS holdback FROM shoppers")
def _(t: Tables):
    return shoppers(t).select("user_id", X.holdback_flag(F.col("user_id")).alias("holdback"))


@query(
    "bucket_range_join",
    f"SELECT user_id, experiment, bucket, {VARIANT_SQL} AS variant FROM buckets JOIN experiments ON name = experiment",
)
def _(t: Tables):
    requests = X.requests_for_active(shoppers(t), t.experiments)
    number = X.bucket(F.col("experiment"), F.col("user_id"))
    return X.bucket_ranges(requests.withColumn("bucket", number), t.experiments)


@query(
    "experiment_assignment",
    f"""
requests AS (SELECT user_id, ['two_tower_v1_vs_baseline', 'ranker_v2', 'old_exp', 'no_such'][user_id % 4 + 1] AS experiment
  FROM shoppers),
sticky AS (SELECT o_custkey AS user_id, experiment, arg_max(o_orderkey % 100, o_orderkey) AS bucket
  FROM orders JOIN requests ON user_id = o_custkey
  WHERE experiment = 'two_tower_v1_vs_baseline' GROUP BY ALL)
---
SELECT r.user_id, r.experiment,
  coalesce(CASE WHEN {HELD_SQL.replace('user_id', 'r.user_id')} THEN -1 WHEN s.bucket IS NOT NULL THEN s.bucket
    WHEN e.status = 'active' THEN b.bucket END, -2)::INTEGER AS bucket,
  CASE WHEN {HELD_SQL.replace('user_id', 'r.user_id')} THEN 'holdback'
    WHEN s.bucket IS NOT NULL THEN CASE WHEN s.bucket < 50 THEN 'control' ELSE 'treatment' END
    WHEN e.status = 'active' THEN CASE WHEN b.bucket >= control_low AND b.bucket < control_high THEN 'control'
      WHEN b.bucket >= treatment_low AND b.bucket < treatment_high THEN 'treatment' ELSE 'unassigned' END
    ELSE 'control' END AS variant
FROM requests r LEFT JOIN experiments e ON e.name = r.experiment
LEFT JOIN sticky s ON s.user_id = r.user_id AND s.experiment = r.experiment
LEFT JOIN buckets b ON b.user_id = r.user_id AND b.experiment = r.experiment
""",
)
def _(t: Tables):
    # Each customer asks for one experiment: two active, one stopped, one
    # unknown. Every order is a logged assignment; customers without orders have none.
    names = F.array(*[F.lit(n) for n in ("two_tower_v1_vs_baseline", "ranker_v2", "old_exp", "no_such")])
    requests = shoppers(t).select(
        "user_id", F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("experiment")
    )
    logged = t.raw("orders")
    bucket = (F.col("o_orderkey") % 100).cast("int")
    # Later order keys were logged later; all within the last day.
    age = F.make_dt_interval(secs=F.lit(80000.0) / (F.col("o_orderkey") + 1))
    earlier = logged.select(
        F.col("o_custkey").alias("user_id"),
        F.lit("two_tower_v1_vs_baseline").alias("experiment"),
        bucket.alias("bucket"),
        F.when(bucket < 50, "control").otherwise("treatment").alias("variant"),
        (now() - age).alias("assigned_at"),
    )
    assigned = X.assign(requests, t.experiments, earlier, now())
    return assigned.withColumn("bucket", F.coalesce("bucket", F.lit(-2)))


@query(
    "active_experiments",
    """
SELECT name, epoch_us(changed_at) AS changed_us FROM (
  SELECT 'exp_' || o_custkey AS name, max(o_orderdate) AS changed_at,
    arg_max(o_orderstatus, epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey) AS status
  FROM orders GROUP BY o_custkey)
WHERE status = 'O'
""",
)
def _(t: Tables):
    # The order history read as a status log: one experiment per customer.
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("stopped")
    log = t.raw("orders").select(
        F.concat(F.lit("exp_"), F.col("o_custkey").cast("string")).alias("name"),
        status.alias("status"),
        F.col("o_orderdate").alias("changed_at"),
        F.col("o_orderkey").alias("seq"),
    )
    changed = F.unix_micros(F.col("changed_at").cast("timestamp"))
    return X.active_experiments(log).select("name", changed.alias("changed_us"))


@query(
    "assignment_counts",
    "SELECT experiment, variant, count(*) AS assignments FROM assignments GROUP BY experiment, variant",
)
def _(t: Tables):
    return X.assignment_counts(assignments(t))


@query(
    "assignment_event_join",
    """
SELECT experiment, variant, event_type, count(*) AS events
FROM interactions JOIN assignments USING (user_id) GROUP BY ALL
""",
)
def _(t: Tables):
    return X.attribute_events(t.interactions, assignments(t))


@query("experiment_rollup", "SELECT *, round(clicks / impressions::DOUBLE, 6) AS ctr FROM rollup")
def _(t: Tables):
    return rollup(t)


@query(
    "returning_users",
    """
SELECT experiment, variant, count(*) AS users, count(*) FILTER (days >= 2) AS returns
FROM assignments LEFT JOIN (SELECT user_id, count(DISTINCT created_at::DATE) AS days FROM interactions GROUP BY user_id)
  USING (user_id) GROUP BY experiment, variant
""",
)
def _(t: Tables):
    return X.returning_users(t.interactions, assignments(t))


@query(
    "experiment_results_join",
    """
SELECT e.name AS experiment, v.variant, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks,
  coalesce(shares, 0) AS shares, coalesce(dwell_ms_total, 0) AS dwell_ms_total
FROM experiments e CROSS JOIN (VALUES ('control'), ('treatment'), ('holdback')) v(variant)
LEFT JOIN rollup r ON r.experiment = e.name AND r.variant = v.variant
""",
)
def _(t: Tables):
    return X.results_with_all_variants(t.experiments, rollup(t))


@query("two_proportion_ztest", "SELECT experiment, round(z, 6) AS z, round(p, 6) AS p_value FROM ztests")
def _(t: Tables):
    return X.two_proportion_ztest(X.two_arms(rollup(t)))


@query(
    "sample_ratio_mismatch",
    f"""
SELECT experiment, round(chi2, 6) AS chi2, round(p, 6) AS p_value, p > {C.SRM_P_THRESHOLD} AS ratio_ok FROM srm
""",
)
def _(t: Tables):
    return X.sample_ratio_mismatch(X.two_arms(rollup(t)), t.experiments)


@query(
    "bonferroni",
    f"SELECT item_id, tests, {C.ALPHA}::DOUBLE / tests AS alpha FROM "
    "(SELECT item_id, count(DISTINCT event_type) AS tests FROM interactions GROUP BY item_id)",
)
def _(t: Tables):
    tests = t.interactions.groupBy("item_id").agg(F.count_distinct("event_type").alias("tests"))
    return tests.withColumn("alpha", X.bonferroni(C.ALPHA, F.col("tests")))


_P2 = f"(ctr * (1 + {C.RELATIVE_MDE}::DOUBLE))"
_MID = f"((ctr + {_P2}) / 2)"


@query(
    "required_sample_size",
    f"""
SELECT item_id, coalesce(CAST(ceil(pow(1.9599639845400536::DOUBLE * sqrt(2 * {_MID} * (1 - {_MID}))
    + 0.8416212335729144::DOUBLE * sqrt(ctr * (1 - ctr) + {_P2} * (1 - {_P2})), 2)
  / nullif(pow({_P2} - ctr, 2), 0)) AS BIGINT), 0) AS per_arm
FROM (SELECT item_id, coalesce(count(*) FILTER (event_type = 'click')
  / nullif(count(*) FILTER ({IMPRESSION_SQL}), 0)::DOUBLE, 0) AS ctr FROM interactions GROUP BY item_id)
""",
)
def _(t: Tables):
    from lodestar.operators.features import item_ctr

    rates = item_ctr(t.interactions)
    return rates.select("item_id", X.required_sample_size(F.col("ctr")).alias("per_arm"))


@query(
    "evaluate_experiment",
    f"""
SELECT z.experiment, 'ctr' AS metric, round(coalesce(x1 / nullif(n1, 0), 0), 6) AS control_value,
  round(coalesce(x2 / nullif(n2, 0), 0), 6) AS treatment_value,
  round(coalesce((x2 / n2 - x1 / n1) / nullif(x1 / n1, 0), 0), 6) AS relative_lift,
  round(z.p, 6) AS p_value, z.p < {C.ALPHA} AND s.p > {C.SRM_P_THRESHOLD} AS is_significant,
  s.p > {C.SRM_P_THRESHOLD} AS sample_ratio_ok
FROM ztests z JOIN srm s ON s.experiment = z.experiment
""",
)
def _(t: Tables):
    return X.evaluate_experiments(rollup(t), t.experiments)


@query(
    "mann_whitney_u",
    f"""
samples AS (SELECT experiment, variant, dwell_ms::DOUBLE AS value FROM interactions JOIN assignments USING (user_id)
  WHERE dwell_ms IS NOT NULL AND variant IN ('control', 'treatment')),
ranked AS (SELECT experiment, variant, value, rank() OVER (PARTITION BY experiment ORDER BY value)
    + (count(*) OVER (PARTITION BY experiment, value) - 1) / 2.0::DOUBLE AS r FROM samples),
ties AS (SELECT experiment, sum(t * t * t - t)::DOUBLE AS ties FROM
  (SELECT experiment, count(*) AS t FROM samples GROUP BY experiment, value) GROUP BY experiment),
u AS (SELECT experiment, count(*) FILTER (variant = 'control') AS n1, count(*) FILTER (variant = 'treatment') AS n2,
    sum(r) FILTER (variant = 'control') - count(*) FILTER (variant = 'control')::DOUBLE
      * (count(*) FILTER (variant = 'control') + 1) / 2 AS u FROM ranked GROUP BY experiment),
z AS (SELECT *, greatest((greatest(u, n1::DOUBLE * n2 - u) - n1::DOUBLE * n2 / 2 - 0.5) / sqrt(n1::DOUBLE * n2 / 12
    * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))), 0) AS z FROM u JOIN ties USING (experiment))
---
SELECT experiment, n1, n2, u, round(least({erfc_sql('abs(z) / 1.4142135623730951::DOUBLE')}, 1), 6) AS p_value FROM z
""",
)
def _(t: Tables):
    samples = X.variant_values(t.interactions, assignments(t), "dwell_ms")
    return X.mann_whitney_u(samples, ["experiment"])


# ---- operational metrics ---------------------------------------------------------------


@query(
    "feed_latency_quantiles",
    """
SELECT CAST(floor(epoch_us(created_at) / 300000000) AS BIGINT) AS slot, count(*) AS requests,
  round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
  round(quantile_cont(latency_ms, 0.99), 6) AS p99
FROM interactions GROUP BY slot
""",
)
def _(t: Tables):
    return M.latency_quantiles(t.interactions)


@query(
    "latency_histogram",
    "SELECT le, (SELECT count(*) FROM interactions WHERE latency_ms / 1000 <= le) AS requests "
    f"FROM (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in C.LATENCY_BUCKETS)}, 'inf'::DOUBLE]) AS le)",
)
def _(t: Tables):
    return M.cumulative_histogram(
        t.interactions, F.col("latency_ms") / 1000.0, C.LATENCY_BUCKETS, "requests"
    )


@query(
    "prediction_score_histogram",
    f"""
preds AS (SELECT 1 / (1 + exp(-value / 100)) AS p FROM interactions)
---
SELECT le, (SELECT count(*) FROM preds WHERE p <= le) AS predictions
FROM (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in C.SCORE_BUCKETS)}, 'inf'::DOUBLE]) AS le)
""",
)
def _(t: Tables):
    score = 1.0 / (1.0 + F.exp(-F.col("value") / 100.0))
    return M.cumulative_histogram(t.interactions, score, C.SCORE_BUCKETS, "predictions")


@query(
    "canary_gate",
    f"""
g AS (SELECT count(*) FILTER (event_type = 'click' AND model_version = 'canary')
      / nullif(count(*) FILTER ({IMPRESSION_SQL} AND model_version = 'canary'), 0)::DOUBLE AS c_ctr,
    count(*) FILTER (event_type = 'click' AND model_version = 'baseline')
      / nullif(count(*) FILTER ({IMPRESSION_SQL} AND model_version = 'baseline'), 0)::DOUBLE AS b_ctr,
    quantile_cont(latency_ms, 0.99) FILTER (model_version = 'canary') AS c_p99,
    quantile_cont(latency_ms, 0.99) FILTER (model_version = 'baseline') AS b_p99 FROM interactions)
---
SELECT 'canary' AS model_version, round(c_ctr - b_ctr, 6) AS ctr_delta, round(c_p99 - b_p99, 6) AS p99_delta_ms,
  c_ctr - b_ctr < -0.05 OR c_p99 - b_p99 > 10 AS rollback,
  c_p99 > b_p99 * 1.2::DOUBLE OR c_ctr < b_ctr * 0.95::DOUBLE AS rollback_relative
FROM g
""",
)
def _(t: Tables):
    return M.canary_gate(t.interactions)
