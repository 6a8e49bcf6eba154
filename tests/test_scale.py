"""Distributed paths against brute force, invariants and plan shapes."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import numbering
from lodestar.operators import experiments as X
from lodestar.operators import features, ingest, ranking, retrieval, training
from lodestar.plans import feed
from lodestar.sources import event_log
from lodestar.sources.bindings import Tables, holdout_start, now
from lodestar.sources.storage import new_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SMALL)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n, dim, key, seed):
    matrix = np.random.default_rng(seed).normal(size=(n, dim))
    rows = [(i, row.tolist()) for i, row in enumerate(matrix)]
    return matrix, spark.createDataFrame(rows, f"{key} long, embedding array<double>")


def brute_force(q, i, k):
    scores = np.rint(q @ i.T * 1e6).astype(np.int64)
    return {(u, int(x)) for u in range(len(q)) for x in np.lexsort((np.arange(len(i)), -scores[u]))[:k]}


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_topk_equals_brute_force(spark, t, broadcast_bytes):
    q, queries = vectors(spark, 70, 8, "user_id", 1)
    i, items = vectors(spark, 300, 8, "item_id", 2)
    found = retrieval.vector_topk(queries, items, 7, unit=False, broadcast_bytes=broadcast_bytes)
    assert {(r.user_id, r.item_id) for r in found.collect()} == brute_force(q, i, 7)


def test_topk_skips_exactly(spark, t):
    q, queries = vectors(spark, 10, 4, "user_id", 1)
    i, items = vectors(spark, 12, 4, "item_id", 2)
    skipped = queries.withColumn("skip", F.when(F.col("user_id") > 0, F.array(*[F.lit(x).cast("bigint") for x in range(9)])))
    found = retrieval.vector_topk(skipped, items, 5, unit=False, skip="skip").collect()
    assert all(r.item_id >= 9 for r in found if r.user_id > 0)
    assert sum(r.user_id == 0 for r in found) == 5 and sum(r.user_id == 3 for r in found) == 3


def test_lsh_recall(spark, t):
    _, queries = vectors(spark, 60, 16, "user_id", 1)
    _, items = vectors(spark, 400, 16, "item_id", 2)
    exact = {(r.user_id, r.item_id) for r in retrieval.vector_topk(queries, items, 10).collect()}
    near = retrieval.vector_topk_lsh(queries, items, 10, dim=16, bits=3, tables=8, probes=1)
    hits = {(r.user_id, r.item_id) for r in near.collect()}
    assert len(exact & hits) / len(exact) > 0.7


def test_global_positions(spark, t):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("v"))
    rows = numbering.global_row_number(df, "v", "n").orderBy("v").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


def test_exact_quantiles(spark, t):
    values = np.random.default_rng(3).exponential(size=500).round(2)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    row = numbering.exact_quantiles(counts, ["g"], "v", "n", {"a": 0.5, "b": 0.99}).collect()[0]
    assert row.a == pytest.approx(np.quantile(values, 0.5)) and row.b == pytest.approx(np.quantile(values, 0.99))


def test_svd_is_as_good_as_numpy(spark, t):
    pairs = training.click_counts(t.interactions)
    users, items = training.cf_svd(pairs, k=5)
    rows = pairs.collect()
    uids = sorted({r.user_id for r in rows})
    iids = sorted({r.item_id for r in rows})
    dense = np.zeros((len(uids), len(iids)))
    for r in rows:
        dense[uids.index(r.user_id), iids.index(r.item_id)] = 1.0
    s = np.linalg.svd(dense, compute_uv=False)
    best = np.sqrt((s[5:] ** 2).sum())
    uf = {r.user_id: r.embedding for r in users.collect()}
    vf = {r.item_id: r.embedding for r in items.collect()}
    left, right = np.array([uf[x] for x in uids]), np.array([vf[x] for x in iids])
    assert np.allclose(right.T @ right, np.eye(5), atol=1e-6)
    assert np.linalg.norm(dense - left @ right.T) < 1.001 * best
    assert np.allclose(np.linalg.norm(left, axis=0), s[:5], rtol=0.01)


def test_negatives_never_positive(spark, t):
    clicks = t.interactions.filter("event_type = 'click'")
    drawn = training.uniform_negatives(clicks, t.items)
    assert drawn.count() == 4 * clicks.count()
    own = clicks.select("event_id", F.col("item_id").alias("own"))
    assert drawn.join(own, "event_id").filter("item_id = own").isEmpty()


def test_random_lists_are_distinct(spark, t):
    drawn = ranking.random_recommend(t.users, t.items, 20)
    sizes = drawn.groupBy("user_id").agg(F.count_distinct("item_id").alias("n")).collect()
    assert len(sizes) == t.users.count() and all(r.n == 20 for r in sizes)
    tiny = t.items.filter("item_id < 3")
    assert ranking.random_recommend(t.users, tiny, 20).count() == 3 * t.users.count()


def test_feed_invariants(spark, t):
    rows = feed.personalized_feed(
        t.interactions, t.items, t.users, t.experiments, now(), feed.FeedSettings(dim=64, depth=60)
    ).collect()
    users = {r.user_id for r in t.users.collect()}
    known = {r.user_id for r in t.interactions.join(t.items, "item_id").select("user_id").distinct().collect()}
    assert {r.user_id for r in rows} == users
    for user in users:
        mine = [r for r in rows if r.user_id == user]
        assert sorted(r.rank for r in mine) == list(range(1, 21))
        assert len({r.item_id for r in mine}) == 20
        assert {r.rank for r in mine if r.is_exploration} == {19, 20}
        assert all(r.is_cold_start == (user not in known) for r in mine)


def test_sessions_hot_user_slots(spark, t):
    # A burst in one slot collapses before the window sees it.
    events = spark.range(5000).select(
        F.lit(1).alias("user_id"),
        (F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 100000)).cast("timestamp_ntz").alias("created_at"),
    )
    rows = ingest.sessionize(events, ["user_id"]).collect()
    assert len(rows) == 1 and rows[0].events == 5000


def test_audit_append_is_idempotent(spark, t):
    path = new_path(spark, "audit-test")
    rows = t.interactions.select("event_id", "user_id", "created_at")
    for _ in range(2):
        event_log.append_new_events(spark, rows, path)
    assert spark.read.parquet(path).count() == rows.count()


def test_audit_append_reads_touched_months_only(spark, t):
    path = new_path(spark, "audit-months")
    rows = t.interactions.select("event_id", "created_at")
    old = rows.select("event_id", F.expr("created_at - interval 400 days").alias("created_at"))
    event_log.write_event_log(rows.unionByName(old), path)
    near = event_log.logged_near(spark, rows, path)
    scan = [line for line in plan_of(near).splitlines() if "PartitionFilters" in line][0]
    assert "2024-01" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert near.count() == rows.count()
    # A repeat in the next month is recognised.
    late = rows.limit(5).select("event_id", F.expr("created_at + interval 31 days").alias("created_at"))
    event_log.append_new_events(spark, late, path)
    assert spark.read.parquet(path).count() == 2 * rows.count()


def test_scoped_stages_are_removed(spark, t):
    from lodestar.sources import storage

    with storage.stages(spark):
        path = storage.cut_lineage(spark.range(3)).inputFiles()[0]
        assert event_log.log_exists(spark, path.rsplit("/", 1)[0])
    assert not event_log.log_exists(spark, path.rsplit("/", 1)[0])


def test_month_predicate_prunes_folders(spark, t):
    path = new_path(spark, "months")
    both = t.interactions.select("event_id", "created_at").unionByName(
        t.interactions.select("event_id", F.expr("created_at - interval 60 days").alias("created_at"))
    )
    event_log.write_event_log(both, path)
    log = spark.read.schema("event_id bigint, created_at timestamp_ntz, event_month string").parquet(path)
    pruned = event_log.month_range(log, holdout_start(), now())
    scan = [line for line in plan_of(pruned).splitlines() if "PartitionFilters" in line][0]
    assert "event_month" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert pruned.count() == t.interactions.filter(F.col("created_at") >= holdout_start()).count()


def test_window_group_limit_and_pushdown(spark, t):
    assert "WindowGroupLimit" in plan_of(features.recent_items(t.interactions))
    assert "WindowGroupLimit" in plan_of(features.user_history(t.interactions, now()))
    trending = plan_of(features.trending_scores(t.interactions, now()))
    assert "GreaterThan(ts" in trending.replace("`", "")


@pytest.mark.parametrize(
    "name",
    [
        "personalized_feed",
        "holdback_feed",
        "experiment_assignment",
        "evaluate_experiment",
        "mann_whitney_u",
        "training_examples",
        "shown_negatives",
        "random_recommend",
        "candidate_union",
        "evaluation_report",
        "ctr_lift",
    ],
)
def test_no_cross_joins(spark, name):
    from __spark_entry__ import queries

    plan = plan_of(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_assignment_precedence(spark, t):
    requests = spark.createDataFrame(
        [(13, "ranker_v2"), (1, "ranker_v2"), (1, "old_exp"), (2, "ranker_v2")], "user_id long, experiment string"
    )
    earlier = spark.createDataFrame([(2, "ranker_v2", 7, "control")], "user_id long, experiment string, bucket int, variant string").withColumn("assigned_at", now() - F.expr("interval 1 day"))
    stale = earlier.withColumn("assigned_at", now() - F.expr("interval 8 days"))
    rows = {(r.user_id, r.experiment): r for r in X.assign(requests, t.experiments, earlier, now()).collect()}
    assert (rows[13, "ranker_v2"].bucket, rows[13, "ranker_v2"].variant) == (-1, "holdback")
    assert (rows[1, "old_exp"].bucket, rows[1, "old_exp"].variant) == (None, "control")
    assert rows[2, "ranker_v2"].bucket == 7
    again = {r.user_id: r for r in X.assign(requests, t.experiments, stale, now()).collect() if r.user_id == 2}
    assert again[2].bucket != 7


def test_grid_keeps_one_list_of_a_query_block(spark, t):
    # Item blocks far beyond the list: rows that leave the products are k a query and column, not k a pair of blocks.
    q, queries = vectors(spark, 300, 8, "user_id", 1)
    i, items = vectors(spark, 40_000, 8, "item_id", 2)
    twice = items.unionAll(items.where("item_id < 50"))
    found = retrieval.vector_topk(queries, items.repartition(3), 5, unit=False, broadcast_bytes=0)
    assert {(r.user_id, r.item_id) for r in found.collect()} == brute_force(q, i, 5)
    small = retrieval.vector_topk(queries.where("user_id < 9"), twice, 5, unit=False, broadcast_bytes=0)
    known = retrieval.vector_topk(queries.where("user_id < 9"), twice, 5, unit=False)
    assert sorted((r.user_id, r.item_id) for r in small.collect()) == sorted((r.user_id, r.item_id) for r in known.collect())

    lists = retrieval._Running(np.arange(300), q.ravel(), None, 5)
    for start in range(0, 40_000, 4096):
        part = slice(start, start + 4096)
        lists.meet(np.arange(40_000)[part], i[part].ravel())
    rows = [frame for frame in lists.rows()]
    assert sum(map(len, rows)) == 300 * 5
    assert {(u, x) for f in rows for u, x in zip(f["q"], f["i"])} == brute_force(q, i, 5)


def test_stored_ids_are_not_copied_through_the_driver(spark, t, monkeypatch):
    made, ratings = [], training._ratings
    monkeypatch.setattr(training, "_ratings", lambda *given: made.append(ratings(*given)) or made[-1])
    pairs = spark.createDataFrame([(i % 20, i % 13, 1) for i in range(200)], "user_id long, item_id long, n long")
    users, items = training.cf_als(pairs, rank=2, iterations=1)
    assert (users.count(), items.count()) == (20, 13)
    assert "BroadcastHashJoin" not in plan_of(made[0]) and made[0].count() == 200


def test_als_blocks_grow_with_the_ratings(spark, t, monkeypatch):
    ratings, als = spark.range(1000), training.ALS()
    assert set(training._blocks(als, ratings).values()) == {training.FEW_BLOCKS}
    monkeypatch.setattr(training, "BLOCK_RATINGS", 200)
    assert set(training._blocks(als, ratings).values()) == {min(5, spark.sparkContext.defaultParallelism)}


def test_candidates_are_shuffled_by_user_once(spark, t):
    found = spark.createDataFrame([(u, i, 0.5) for u in range(3) for i in range(4)], "user_id long, item_id long, score double")
    listed = spark.createDataFrame([(3, 1), (9, 2), (None, 3)], "item_id long, position int")
    users = spark.range(4).select(F.col("id").alias("user_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        union = retrieval.candidate_union(found, users, listed, listed)
        ranked = ranking.rerank_adjust(
            ranking.seen_flags(union.withColumn("created_at", now()), found.where("item_id = 1")), now()
        )
        # By user: the candidates once, the seen lists once.
        plan = plan_of(ranked)
        assert plan.count("Exchange hashpartitioning(user_id") == 2 and "hashpartitioning(user_id#" in plan
        assert not re.search(r"hashpartitioning\(user_id#\d+L?, item_id", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = {(r.user_id, r.item_id): (r.source, r.seen) for r in ranked.collect()}
    assert rows[0, 1] == (0, True) and rows[0, 3] == (0, False) and rows[3, 9] == (1, False)
    assert len(rows) == 3 * 5 + 2


def test_lists_of_a_group_are_not_shuffled(spark, t, monkeypatch):
    # Small groups, so every item block goes to several; a query's list is whole when it leaves its task.
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    q, queries = vectors(spark, 130, 8, "user_id", 1)
    i, items = vectors(spark, 500, 8, "item_id", 2)
    found = retrieval.vector_topk(queries, items, 7, unit=False, broadcast_bytes=0)
    assert "Window" not in plan_of(found)
    rows = found.collect()
    assert {(r.user_id, r.item_id) for r in rows} == brute_force(q, i, 7) and len(rows) == 7 * 130
    assert {(r.user_id, r["rank"]) for r in rows} == {(u, n) for u in range(130) for n in range(1, 8)}

    parted = [df.withColumn("half", F.col(key) % 2) for df, key in ((queries, "user_id"), (items, "item_id"))]
    skipped = parted[0].withColumn("skip", F.when(F.col("user_id") > 9, F.sequence(F.lit(0), F.lit(399))))
    lists = [
        retrieval.vector_topk(skipped, parted[1], 7, by="half", unit=False, skip="skip", broadcast_bytes=most).collect()
        for most in (1 << 30, 0)
    ]
    assert len({tuple(sorted((r.user_id, r["rank"], r.item_id, r.score) for r in rows)) for rows in lists}) == 1
    assert len(lists[0]) == 7 * 130


def test_lsh_sends_a_vector_once(spark, t):
    # A query's best 4 of every cell that it visits, from whole vectors that are not repeated per cell.
    q, queries = vectors(spark, 50, 8, "user_id", 1)
    i, items = vectors(spark, 300, 8, "item_id", 2)
    twice = items.unionAll(items.where("item_id < 30"))
    near = retrieval.vector_topk_lsh(queries, twice, 4, dim=8, bits=3, tables=3, probes=1)
    assert "explode(cells" not in plan_of(near)
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, i)]
    scores = np.rint(unit[0] @ unit[1].T * 1e6).astype(int)
    planes, powers, expected = retrieval._planes(8, 3, 3, 7), 1 << np.arange(3), set()
    ids = [*range(300), *range(30)]
    for u in range(50):
        found = set()
        for plane in planes:
            margin = q[u] @ plane.T
            own = int((margin > 0) @ powers)
            for cell in (own, own ^ int(powers[np.argmin(abs(margin))])):
                inside = [x for x in ids if int((i[x] @ plane.T > 0) @ powers) == cell]
                found |= set(sorted(inside, key=lambda x: (-scores[u, x], x))[:4])
        expected |= {(u, x) for x in sorted(found, key=lambda x: (-scores[u, x], x))[:4]}
    assert {(r.user_id, r.item_id) for r in near.collect()} == expected


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_items_keep_their_number_type(spark, t, broadcast_bytes):
    # Workers hold item vectors as stored, half the bytes of doubles; products are made of doubles.
    import pandas as pd

    known = pd.DataFrame({"id": [2, 1], "v": [[1.0, 2.0], [3.0, 4.0]], "part": [0, 0]})
    ids, matrix = retrieval._parts(known, "float32")[0]
    assert list(ids) == [1, 2] and matrix.dtype == np.float32
    q, queries = vectors(spark, 40, 8, "user_id", 1)
    i, items = vectors(spark, 200, 8, "item_id", 2)
    narrow = items.withColumn("embedding", F.col("embedding").cast("array<float>"))
    found = retrieval.vector_topk(queries, narrow, 7, unit=False, broadcast_bytes=broadcast_bytes)
    assert {(r.user_id, r.item_id) for r in found.collect()} == brute_force(q, i.astype(np.float32).astype(float), 7)


@pytest.mark.parametrize("size", [1.0, 3e3, 1e-4, 1e20])
def test_rough_products_lose_no_item(monkeypatch, size):
    # Long vectors, whose float products are off by many steps of a score, tied and numberless ones among them.
    rng = np.random.default_rng(4)
    q, i = rng.normal(size=(300, 8)) * size, rng.normal(size=(9000, 8))
    i[5000:5040] = i[7]
    i[8000:] = i[6000:7000] * (1 + 1e-12)
    i[100] = np.nan
    skips = [np.arange(20, 20 + u % 50) for u in range(300)]
    monkeypatch.setattr(retrieval._Running, "_cut", counted := _counting(retrieval._Running._cut))
    lists = retrieval._Running(np.arange(300), q.ravel(), skips, 30)
    for start in range(0, 9000, 1500):
        lists.meet(np.arange(9000)[start : start + 1500], i[start : start + 1500].ravel())
    frames = [f for f in lists.rows()]
    got = {(u, x): (s, r) for f in frames for u, x, s, r in zip(f["q"], f["i"], f["score"], f["rank"])}
    assert len(got) == 300 * 30
    products = np.rint(q @ i.T * retrieval.SCORE_SCALE)
    for u in range(0, 300, 7):
        products[u, skips[u]] = np.nan
        # Scores of rounded products may differ by a step where those are made one by one.
        best = np.sort(products[u][~np.isnan(products[u])])[::-1][:30]
        own = np.sort([s for (v, _), (s, _) in got.items() if v == u])[::-1] * retrieval.SCORE_SCALE
        assert np.allclose(own, best, rtol=1e-12, atol=1.01) and not {x for v, x in got if v == u} & {100, *skips[u]}
    assert counted.calls <= 3 * len(lists.parts)


def _counting(method):
    def counted(*given):
        counted.calls += 1
        return method(*given)

    counted.calls = 0
    return counted


def test_exact_products_are_made_of_few_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    q, i = rng.normal(size=(256, 16)), rng.normal(size=(60_000, 16))
    lists = retrieval._Running(np.arange(256), q.ravel(), None, 10)
    made, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: made.append(len(a)) or einsum(how, a, b))
    for start in range(0, 60_000, 3000):
        lists.meet(np.arange(60_000)[start : start + 3000], i[start : start + 3000].ravel())
    # All blocks but the first are met as floats.
    assert len(made) == 19 and sum(made) < 0.01 * 256 * 60_000
    assert {(u, x) for f in lists.rows() for u, x in zip(f["q"], f["i"])} == brute_force(q, i, 10)


@pytest.mark.parametrize("block, expected", [(10_000, (4, 2, "MEMORY_AND_DISK")), (25, (20, 1, "DISK_ONLY"))])
def test_large_tunings_hold_one_model_and_small_blocks(spark, t, monkeypatch, block, expected):
    # Blocks don't grow with the ratings beyond the cores, and two large models are not in memory at once.
    made, search = [], training.TrainValidationSplit
    monkeypatch.setattr(training, "TrainValidationSplit", lambda **given: made.append(given) or search(**given))
    monkeypatch.setattr(training, "BLOCK_RATINGS", block)
    pairs = spark.createDataFrame([(i % 50, i // 50, 1 + i % 3) for i in range(500)], "user_id long, item_id long, n long")
    rows = training.tune_factorization(pairs, [2], [0.1], iterations=1).collect()
    als = made[0]["estimator"]
    assert len(rows) == 1 and rows[0].rmse > 0
    assert (als.getNumUserBlocks(), made[0]["parallelism"], als.getIntermediateStorageLevel()) == expected
