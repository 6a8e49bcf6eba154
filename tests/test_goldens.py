"""Small inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions import hashing as H
from lodestar.functions import vectors as V
from lodestar.operators import evaluation, explain, features, ingest, ranking, training
from lodestar.operators import experiments as X
from lodestar.sources.bindings import now

T0 = dt.datetime(2024, 1, 1)


def one(df):
    return df.collect()[0]


def arms(spark, c_clicks, c_total, t_clicks, t_total):
    return spark.createDataFrame(
        [("e", c_clicks, c_total, t_clicks, t_total)],
        "experiment string, c_clicks long, c_total long, t_clicks long, t_total long",
    )


def test_z_test(spark):
    row = one(X.two_proportion_ztest(arms(spark, 500, 10000, 650, 10000)))
    assert row.z == pytest.approx(4.556188, abs=1e-6) and row.p_value == pytest.approx(5e-6, abs=1e-6)
    row = one(X.two_proportion_ztest(arms(spark, 500, 10000, 505, 10000)))
    assert row.z == pytest.approx(0.161839, abs=1e-6) and row.p_value == pytest.approx(0.871433, abs=1e-6)


def test_z_test_without_traffic(spark):
    row = one(X.two_proportion_ztest(arms(spark, 0, 0, 5, 10)))
    assert (row.z, row.p_value) == (0.0, 1.0)


def test_sample_ratio(spark):
    row = one(X.sample_ratio_mismatch(arms(spark, 0, 45000, 0, 55000)))
    assert row.chi2 == 1000.0 and not row.ratio_ok
    row = one(X.sample_ratio_mismatch(arms(spark, 0, 50100, 0, 49900)))
    assert row.chi2 == pytest.approx(0.4) and row.p_value == pytest.approx(0.527089, abs=1e-6) and row.ratio_ok
    assert one(X.sample_ratio_mismatch(arms(spark, 0, 0, 0, 0))).ratio_ok


def test_bonferroni_and_sample_size(spark):
    row = one(
        spark.range(1).select(
            X.bonferroni(0.05, F.lit(5)).alias("alpha"), X.required_sample_size(F.lit(0.1)).alias("n")
        )
    )
    assert row.alpha == pytest.approx(0.01) and row.n == 356335


def test_mann_whitney_matches_pair_counting(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 5.0, 7.0]
    rows = [("e", "control", v, 1) for v in a] + [("e", "treatment", v, 1) for v in b]
    df = spark.createDataFrame(rows, "experiment string, variant string, value double, n long")
    counts = df.groupBy("experiment", "variant", "value").agg(F.sum("n").alias("n"))
    expected = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    row = one(X.mann_whitney_u(counts, ["experiment"]))
    assert row.u == expected and 0 < row.p_value <= 1


def test_buckets_and_holdback(spark):
    users = spark.range(150).withColumnRenamed("id", "user_id")
    name = F.lit("two_tower_v1_vs_baseline")
    found = {r.user_id: r.b for r in users.select("user_id", X.bucket(name, F.col("user_id")).alias("b")).collect()}
    assert [found[u] for u in (0, 8, 149)] == [98, 19, 52]
    held = users.filter(X.holdback_flag(F.col("user_id"))).collect()
    assert {r.user_id for r in held} == {13, 24, 86, 101, 107, 124}


def test_hash_mod_equals_whole_digest(spark):
    import hashlib

    rows = spark.range(50).select(F.col("id").cast("string").alias("s"))
    for r in rows.select("s", H.hash_mod(F.col("s"), 10000).alias("m")).collect():
        assert r.m == int(hashlib.sha256(r.s.encode()).hexdigest(), 16) % 10000


def test_freshness_and_composite(spark):
    row = one(
        spark.range(1).select(
            E.freshness(now() - F.expr("interval 48 hours"), now()).alias("half"),
            E.freshness(now() + F.expr("interval 5 hours"), now()).alias("future"),
            E.composite(F.lit(1.0), F.lit(0.0)).alias("a"),
            E.composite(F.lit(0.0), F.lit(1.0)).alias("b"),
        )
    )
    assert (row.half, row.future) == (0.5, 1.0)
    assert row.a == pytest.approx(0.3) and row.b == pytest.approx(0.7)


def lists(spark, per_user):
    rows = [("x", u, u * 100 + i, i + 1, rel) for u, rels in enumerate(per_user) for i, rel in enumerate(rels)]
    return spark.createDataFrame(
        rows, "approach string, user_id long, item_id long, rank int, relevance int"
    )


def test_ndcg_mrr_coverage_auc(spark):
    assert one(evaluation.ndcg_at_k(lists(spark, [[1, 1, 0, 0]]), 4)).ndcg == 1.0
    assert one(evaluation.ndcg_at_k(lists(spark, [[0, 1, 0, 1]]), 4)).ndcg == pytest.approx(0.650921, abs=1e-6)
    assert one(evaluation.ndcg_at_k(lists(spark, [[0, 0]]), 4)).ndcg == 0.0
    assert one(evaluation.mrr(lists(spark, [[0, 0, 1, 0], [1, 0, 0, 0]]))).mrr == pytest.approx(2 / 3)
    catalogue = spark.range(10).withColumnRenamed("id", "item_id")
    assert one(evaluation.catalog_coverage(lists(spark, [[0, 1]]), catalogue)).coverage == 0.2
    scored = spark.createDataFrame(
        [("x", 0.1, 0), ("x", 0.2, 0), ("x", 0.8, 1), ("x", 0.9, 1)], "m string, score double, label int"
    )
    assert one(evaluation.auc(scored, ["m"])).auc == 1.0
    tied = spark.createDataFrame([("x", 0.5, 0), ("x", 0.5, 1)], "m string, score double, label int")
    assert one(evaluation.auc(tied, ["m"])).auc == 0.5


def test_diversity(spark):
    items = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])],
        "item_id long, embedding array<double>",
    )
    rows = spark.createDataFrame(
        [("same", i) for i in (1, 2, 3)] + [("apart", i) for i in (1, 4)] + [("single", 1)],
        "name string, item_id long",
    )
    found = {r.name: r.diversity for r in evaluation.diversity(rows, items, ["name"], 2).collect()}
    assert found["same"] == pytest.approx(0.0, abs=1e-6)
    assert found["apart"] == pytest.approx(1.0, abs=1e-6) and found["single"] == 0.0


def test_mmr_golden_and_missing_vectors(spark):
    rows = [
        (1, 1, 0.9, [1.0, 0.0]),
        (1, 2, 0.85, [1.0, 0.0]),
        (1, 3, 0.8, [0.6, 0.8]),
        (1, 4, 0.3, [0.0, 1.0]),
        (1, 5, 0.99, None),
    ]
    df = spark.createDataFrame(rows, "user_id long, item_id long, score double, embedding array<float>")
    order = [r.item_id for r in ranking.mmr_rerank(df.drop("embedding"), df.select("item_id", "embedding"), 5).orderBy("rank").collect()]
    assert order == [1, 3, 2, 4, 5]


def test_category_cap_is_a_permutation(spark):
    rows = [(1, i, i, "sports" if i <= 8 else "news") for i in range(1, 11)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rank int, category string")
    order = [r.item_id for r in ranking.category_cap(df).orderBy("rank").collect()]
    assert order == [1, 2, 3, 4, 9, 10, 5, 6, 7, 8]


def test_dedupe_fold(spark):
    times = [0, 1800, 3500, 3700, 7000, 7300]
    rows = [(7, T0 + dt.timedelta(seconds=s)) for s in times + [0]] + [(8, T0)]
    df = spark.createDataFrame(rows, "event_id long, created_at timestamp_ntz")
    accepted = ingest.dedupe_events(df).collect()
    found = sorted((r.event_id, int((r.created_at - T0).total_seconds())) for r in accepted)
    assert found == [(7, 0), (7, 3700), (7, 7300), (8, 0)]


def test_dedupe_of_a_busy_id(spark):
    """A year of one id, a delivery a minute, in one job."""
    minutes = 365 * 1440
    times = spark.range(minutes).select(
        F.lit(1).cast("bigint").alias("event_id"),
        (F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 60_000_000)).cast("timestamp_ntz").alias("created_at"),
    )
    assert ingest.dedupe_events(times).count() == minutes // 60


def test_mann_whitney_with_ten_million_ties(spark):
    rows = [("e", v, x, n) for v, n in (("control", 5_000_000), ("treatment", 5_000_000)) for x in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "experiment string, variant string, value double, n long")
    row = one(X.mann_whitney_u(df, ["experiment"]))
    assert row.u == 10_000_000.0**2 / 2 and row.p_value == 1.0


def test_auc_of_billions(spark):
    rows = [("a", 0.1, 0, 4_000_000_000), ("a", 0.9, 1, 4_000_000_000)]
    counts = spark.createDataFrame(rows, "approach string, score double, label int, n long")
    pos = F.when(F.col("label") == 1, F.col("n")).otherwise(0).alias("pos")
    found = one(evaluation.auc_of_counts(counts.select("approach", "score", pos, "n"), ["approach"]))
    assert found.auc == 1.0


def test_sample_ratio_of_an_uneven_split(spark):
    experiments = spark.createDataFrame(
        [("e", 0, 50, 50, 90)], "name string, control_low int, control_high int, treatment_low int, treatment_high int"
    )
    row = one(X.sample_ratio_mismatch(arms(spark, 0, 50_000, 0, 40_000), experiments))
    assert row.ratio_ok and row.chi2 == 0
    assert not one(X.sample_ratio_mismatch(arms(spark, 0, 45_000, 0, 45_000), experiments)).ratio_ok


def test_clock_gate(spark):
    at = dt.datetime(2024, 1, 10)
    offsets = {"hour ahead": 3600, "old": -30 * 86400, "fine": -300, "edge": 300}
    rows = [(n, at + dt.timedelta(seconds=s), at) for n, s in offsets.items()] + [("none", None, at)]
    df = spark.createDataFrame(rows, "name string, client_timestamp timestamp_ntz, created_at timestamp_ntz")
    assert {r.name for r in ingest.timestamp_gate(df).collect()} == {"fine", "edge", "none"}


def test_popularity_order(spark):
    counts = spark.createDataFrame([(1, 5), (2, 50), (3, 1)], "item_id long, interactions long")
    users = spark.createDataFrame([(9,)], "user_id long")
    ranked = ranking.popularity_recommend(users, counts, 3).orderBy("rank").collect()
    assert [r.item_id for r in ranked] == [2, 1, 3]


def test_pad_sequence(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([7],), ([],)], "s array<bigint>")
    padded = [r[0] for r in df.select(features.pad_sequence(F.col("s"), 3)).collect()]
    assert padded == [[2, 3, 4], [0, 0, 7], [0, 0, 0]]


def test_trending_flag_needs_five_items(spark):
    few = spark.createDataFrame([(i, 1.0 + 99 * (i == 0)) for i in range(4)], "item_id long, score double")
    assert not any(r.is_trending for r in features.trending_flags(few, 1.0).collect())
    many = spark.createDataFrame([(i, 1.0 + 99 * (i == 0)) for i in range(20)], "item_id long, score double")
    assert [r.item_id for r in features.trending_flags(many).collect() if r.is_trending] == [0]


def test_bandit_extremes(spark):
    rows = [(u, i) for u in range(200) for i in (1, 2)]
    pool = spark.createDataFrame(rows, "user_id long, item_id long")
    arms_df = spark.createDataFrame([(1, 0.2), (2, 0.9)], "item_id long, mean_reward double")
    greedy = ranking.bandit_select(pool, arms_df, epsilon=0.0).collect()
    assert {r.item_id for r in greedy} == {2}
    explored = ranking.bandit_select(pool, arms_df, epsilon=1.0).collect()
    assert {r.item_id for r in explored} == {1, 2}


def test_linear_attribution_and_text(spark):
    values = [[1.0] + [0.0] * 6, [0.0] * 7]
    df = spark.createDataFrame([tuple(v) for v in values], ", ".join(f"{n} double" for n in C.RANKING_FEATURES))
    weights = [1.0] * 7
    done = explain.linear_attribution(df, weights).withColumn("text", explain.explanation_text())
    rows = done.orderBy(F.desc("user_item_dot_product")).collect()
    assert rows[0].c_user_item_dot_product == 0.5
    assert rows[0].text == C.EXPLANATIONS["user_item_dot_product"]
    assert one(explain.false_attribution_rate(done, "user_item_dot_product")).rate == 1.0
    with pytest.raises(ValueError):
        explain.false_attribution_rate(done, "no_such_feature")


def test_softmax_loss_is_log_count_for_equal_logits(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "item_id long, embedding array<double>")
    users = spark.createDataFrame([(1, [1.0, 1.0])], "user_id long, embedding array<double>")
    positives = spark.createDataFrame([(10, 1, 0)], "event_id long, user_id long, item_id long")
    negatives = spark.createDataFrame([(10, 1, j, j) for j in (1, 2, 3, 4)], "event_id long, user_id long, j int, item_id long")
    loss = one(training.sampled_softmax_loss(positives, negatives, users, items)).loss
    import math

    assert loss == pytest.approx(math.log(5))


def test_cosine(spark):
    row = one(spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")).alias("c")))
    assert row.c == pytest.approx(0.96)
