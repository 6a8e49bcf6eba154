"""Candidate lists that stay packed, diversity by groups, and rounding, against their plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions.rounding import round_double
from lodestar.operators import ranking, retrieval


def vectors(spark, n, dim, key, seed):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(seed).normal(size=(n, dim)))]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


def test_rounding_equals_sparks(spark):
    odd = [0.0, -0.0, -1e-9, None, float("nan"), float("inf"), 0.5e-6, -2.5e-6, 1e300, -1e18, 123456.7890125, 5e-324, 1.0000005]
    some = [float(x) for x in np.random.default_rng(1).normal(size=2000)] + [i / 2e6 for i in range(-2000, 2000)]
    df = spark.createDataFrame([(x,) for x in odd + some], "x double")
    got = df.select(*[f(F.col("x"), d).alias(f"{name}{d}") for d in (6, 9) for name, f in (("a", F.round), ("b", round_double))])
    for r in got.collect():
        assert (str(r.a6), str(r.a9)) == (str(r.b6), str(r.b9))


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_lists_equal_rows_and_are_not_grouped(spark, broadcast_bytes):
    queries, items = vectors(spark, 30, 8, "user_id", 1), vectors(spark, 60, 8, "item_id", 2)
    twice = items.unionByName(items.where("item_id % 7 = 0").withColumn("embedding", F.reverse("embedding")))
    users = spark.range(33).select(F.col("id").alias("user_id"))
    explored = spark.createDataFrame([(3, 1), (900, 2), (None, 3)], "item_id long, position int")
    trending = spark.createDataFrame([(900, 1), (901, 2)], "item_id long, position int")
    unions = []
    for listed in (False, True):
        found = retrieval.vector_topk(queries, twice, 9, broadcast_bytes=broadcast_bytes, listed=listed)
        unions.append(retrieval.candidate_union(found, users, explored, trending))
    plain, packed = ({(r.user_id, r.item_id, r.score, r.source) for r in u.collect()} for u in unions)
    assert plain == packed and unions[1].count() == len(packed)
    assert {(i, s) for u, i, _, s in packed if u == 32} == {(3, 1), (900, 1), (901, 2)}
    # Lists are not sent whole to all tasks, however small they are guessed.
    assert "SortMergeJoin" in unions[1]._jdf.queryExecution().executedPlan().toString()
    plan = unions[1]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[user_id" in plan and ", item_id" not in "".join(x for x in plan.split("\n") if "Aggregate(keys" in x)


@pytest.mark.parametrize("width", ["array<float>", "array<double>"])
def test_diversity_by_groups_sends_no_vector_per_candidate(spark, monkeypatch, width):
    items = vectors(spark, 40, 6, "item_id", 3).where("item_id != 5").withColumn("embedding", F.col("embedding").cast(width))
    pairs = [(u, i, round((((u or 0) * 37 + i * 11) % 29) / 29, 6)) for u in [*range(25), None] for i in range(0, 44, 1 + (u or 0) % 3)]
    ranked = spark.createDataFrame(pairs, "user_id long, item_id long, score double")
    known = ranking.mmr_rerank(ranked, items, 8).collect()
    monkeypatch.setattr(ranking, "item_matrix", lambda items: None)
    monkeypatch.setattr(ranking, "GROUP_USERS", 1)
    picked = ranking.mmr_rerank(ranked, items, 8)
    assert sorted(map(repr, picked.collect())) == sorted(map(repr, known)) and len(known) == 26 * 8
    assert "Join" not in picked._jdf.queryExecution().executedPlan().toString()


def test_scorer_passes_other_columns(spark):
    rows = [(1, "a", *[0.5] * 7), (2, None, *[0.25] * 6, None)]
    df = spark.createDataFrame(rows, "user_id long, note string, " + ", ".join(f"{n} double" for n in C.RANKING_FEATURES))
    scored = ranking.pluggable_score(df, lambda m: np.nan_to_num(m).sum(axis=1))
    assert [(r.user_id, r.note, r.score) for r in scored.orderBy("user_id").collect()] == [(1, "a", 3.5), (2, None, 1.5)]
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()


def test_packed_candidates_equal_rows_and_are_dealt_once(spark):
    items = vectors(spark, 30, 6, "item_id", 3)
    pairs = [(u, i, round(((u or 0) * 37 + i * 11) % 29 / 29, 6)) for u in [*range(12), None] for i in range((u or 0) % 3, 34)]
    ranked = spark.createDataFrame([*pairs, pairs[5], (40, 3, 0.5)], "user_id long, item_id long, score double")
    packed = ranking.pack_candidates(ranked)
    assert packed.count() == 14
    feeds = [ranking.mmr_rerank(c, items, 8) for c in (ranked, packed)]
    assert sorted(map(repr, feeds[0].collect())) == sorted(map(repr, feeds[1].collect()))
    assert sorted(map(repr, ranking.mmr_rerank(ranking.pack_candidates(ranked, 0.2), items, 8).collect())) == sorted(
        map(repr, ranking.mmr_rerank(ranked, items, 8, 0.2).collect())
    )
    feed = feeds[0].filter("user_id != 4")
    pools = [ranking.exploration_pool(c, feed).select("user_id", "item_id", "score") for c in (ranked, packed)]
    assert sorted(map(repr, pools[0].collect())) == sorted(map(repr, pools[1].collect())) and pools[0].count() > 200
    arms = spark.createDataFrame([(i, i % 5 / 5) for i in range(0, 34, 2)], "item_id long, mean_reward double")
    served = [ranking.bandit_inject(feed, c, arms, 8, 0.3) for c in (ranked, packed)]
    assert sorted(map(repr, served[0].collect())) == sorted(map(repr, served[1].collect()))


def test_large_catalogues_are_looked_up_where_candidates_are(spark):
    # More items than 64 MB of look-ups: candidates, a thousand a user, would be shuffled by item and by user again.
    items = spark.range(600_000).select(F.col("id").alias("item_id"), F.lit("news").alias("category"), F.current_timestamp().alias("created_at"))
    some = spark.createDataFrame([(1, 5, 0.5)], "user_id long, item_id long, score double")
    affinity = spark.createDataFrame([(1, "news", 0.5)], "user_id long, category string, affinity double")
    stats = spark.createDataFrame([(5, 0.25, 0.75)], "item_id long, ctr double, popularity double")
    found = ranking.ranking_features(some, items, affinity, stats, stats, F.current_timestamp())
    assert "_part" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert (row.category, row.historical_ctr, row.popularity_score, row.user_item_category_affinity) == ("news", 0.25, 0.75, 0.5)


def test_feed_shuffles_lists_as_numbers(spark):
    from lodestar.plans import feed

    items = vectors(spark, 30, 6, "item_id", 3).withColumns({"category": F.lit("news"), "created_at": F.current_timestamp()})
    profiles = vectors(spark, 5, 6, "user_id", 4).withColumns(
        {"is_cold_start": F.lit(False), "affinity": F.create_map(F.lit("news"), F.lit(0.5)), "recent": F.array(F.lit(3).cast("long"))}
    ).unionByName(spark.sql("SELECT 9L user_id, null embedding, true is_cold_start, null affinity, null recent"))
    listed = spark.createDataFrame([(3, 1), (900, 2)], "item_id long, position int")
    found = feed.packed_candidates(profiles, items, listed, listed, 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Pairs are made after the lists have been dealt by user.
    assert 0 <= plan.index("arrays_zip") < plan.index("Join LeftOuter") and "arrays_zip" not in plan[plan.index("Join LeftOuter") :]
    rows = found.collect()
    exact = retrieval.vector_topk(profiles, items, 7).collect()
    known = {(r.user_id, r.item_id): r.score for r in exact}
    expected = {(u, i): known.get((u, i), 0.0) for u, i in {*known, *((u, i) for u in (*range(5), 9) for i in (3, 900))}}
    assert {(r.user_id, r.item_id): r.score for r in rows} == expected and len(rows) == len(expected)


def test_feed_looks_a_million_items_up(spark, monkeypatch):
    # Candidates of a feed carry their user's profile: they are not shuffled by item before a million items.
    from lodestar.functions import joins
    from lodestar.plans import feed
    from lodestar.plans.ranking_queries import settings
    from lodestar.sources.bindings import NOW, EXPERIMENTS

    class Found(Exception):
        pass

    def asked(many, one, on, deal, how, row_bytes, most_bytes=joins.LOOKUP_BYTES, counted=None):
        raise Found(most_bytes // row_bytes)

    monkeypatch.setattr(feed, "lookup_join", asked)
    items = vectors(spark, 4, 64, "item_id", 3).withColumns({"category": F.lit("news"), "created_at": F.lit(NOW).cast("timestamp_ntz")})
    events = spark.sql(f"SELECT 1L event_id, 1L user_id, 2L item_id, 'click' event_type, timestamp_ntz'{NOW}' created_at, 5 dwell_ms")
    users = spark.sql(f"SELECT 1L user_id, timestamp_ntz'{NOW}' created_at, array('news') onboarding_categories, '{{}}' metadata")
    experiments = spark.createDataFrame(EXPERIMENTS, "name string, control_low int, control_high int, treatment_low int, treatment_high int, status string")
    with pytest.raises(Found) as most:
        feed.personalized_feed(events, items, users, experiments, F.lit(NOW).cast("timestamp_ntz"), settings())
    assert most.value.args[0] >= 1_000_000
