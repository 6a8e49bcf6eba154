"""Joins with tables of one row per key: sent whole, or spread beyond the bound."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions.events import is_impression
from lodestar.functions.joins import counted_join, lookup_join
from lodestar.operators.features import ctr_before


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most_bytes", [1 << 20, 256])
def test_both_ways_give_the_same_rows(spark, how, most_bytes):
    many = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    one = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    found = lookup_join(many, one, ["k"], F.col("id"), how, most_bytes=most_bytes)
    want = [(i % 7, i, (i % 7) * 10 if i % 7 < 5 else None) for i in range(300) if how == "left" or i % 7 < 5]
    assert sorted(map(tuple, found.select("k", "id", "v").collect()), key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Within the bound nothing is copied; beyond it the one-side is generated once per part.
    assert ("Generate explode" in plan) == (most_bytes == 256)


def test_the_bound_counts_another_frame(spark):
    many = spark.range(10).select(F.col("id").alias("k"))
    one = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    found = lookup_join(many, one, ["k"], F.col("k"), counted=spark.range(10_000_000), most_bytes=2560)
    assert "Generate explode" in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 10


def test_counted_join_copies_busy_keys_only(spark):
    many = spark.range(3000).select(F.col("id").alias("e"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    one = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2).where("k <> 2500")
    found = counted_join(many, one, ["k"], F.col("e"), "n", busy=100)
    assert sorted(found.columns) == ["e", "k", "v"]
    rows = found.collect()
    assert sorted(r.e for r in rows) == list(range(3000))
    assert all(r.v == (None if r.k == 2500 else 2 * r.k) for r in rows)
    assert counted_join(many, one.limit(0), ["k"], F.col("e"), "n").where("v IS NULL").count() == 3000


def test_click_rates_before_days_that_are_asked(spark):
    events = [
        (1, "click", "2024-01-01 10:00:00"),
        (1, "view", "2024-01-01 11:00:00"),
        (1, "click", "2024-01-03 09:00:00"),
        (1, "view", "2024-01-09 09:00:00"),
        (2, "view", "2024-01-02 09:00:00"),
        (None, "view", "2024-01-02 09:00:00"),
    ]
    log = spark.createDataFrame(events, "item_id long, event_type string, created_at string")
    log = log.withColumn("created_at", F.to_timestamp("created_at"))
    asked = [(1, d) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-04", "2024-02-01")]
    asked = spark.createDataFrame([*asked, (2, "2024-01-02"), (2, "2024-03-01"), (3, "2024-01-05")], "item_id long, day string")
    found = ctr_before(log, asked.withColumn("day", F.to_date("day"))).collect()
    shown = log.where(is_impression(F.col("event_type"))).collect()
    clicks = [e for e in events if e[1] == "click"]
    want = {}
    for r in asked.collect():
        before = [s for s in shown if s.item_id == r.item_id and str(s.created_at)[:10] < r.day]
        if before:
            got = [c for c in clicks if c[0] == r.item_id and c[2][:10] < r.day]
            ratio, n = want.get((r.item_id, r.day), (0, 0))
            want[r.item_id, r.day] = (len(got) / len(before), n + 1)
    assert {(r.item_id, str(r.day)): (r.ctr, r.n) for r in found} == want and want
    own = ctr_before(log).collect()
    assert all(r.n > 0 for r in own) and {(r.item_id, str(r.day)) for r in own} <= {(e[0], e[2][:10]) for e in events}
