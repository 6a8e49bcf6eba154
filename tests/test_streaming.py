"""Streams over several micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from lodestar.sources.bindings import Tables
from lodestar.sources.storage import new_path
from lodestar.streaming import io
from lodestar.streaming import operators as S

SCHEMA = "event_id bigint, user_id bigint, item_id bigint, event_type string, created_at timestamp"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def files(spark, batches):
    """One file per batch, read one per trigger in order."""
    Tables(spark, "/root/testdata/sf0.001")
    path = new_path(spark, "input")
    schema = spark.createDataFrame([], SCHEMA).schema
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame([(e, u, i, k, T0 + dt.timedelta(seconds=s)) for e, u, i, k, s in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(f"{path}/{number}")
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def test_duplicates_across_batches(spark):
    stream = files(spark, [[(1, 1, 1, "click", 0), (2, 1, 2, "click", 5)], [(1, 1, 1, "click", 60), (3, 2, 1, "click", 61)]])
    rows = io.run_append(S.dedupe(stream).select("event_id"), "dedupe").collect()
    assert sorted(r.event_id for r in rows) == [1, 2, 3]


def test_recent_items_state(spark):
    first = [(i, 1, i, "click", i) for i in range(60)]
    second = [(100, 1, 3, "save", 500), (101, 2, 9, "click", 501)]
    stream = files(spark, [first, second])
    current = io.run_newest(S.recent_items(stream), "recent", ["user_id"]).orderBy("position").collect()
    mine = [r.item_id for r in current if r.user_id == 1]
    assert len(mine) == 50 and mine[0] == 3 and mine[1] == 59
    assert [r.item_id for r in current if r.user_id == 2] == [9]


def test_recent_items_out_of_order(spark):
    first = [(i, 1, i, "click", 1000 + i) for i in range(50)]
    late = [(100, 1, 200, "click", 1010)]
    later = [(101, 1, 201, "click", 1005), (102, 1, 0, "click", 900)]
    current = io.run_newest(S.recent_items(files(spark, [first, late, later])), "recent", ["user_id"]).collect()
    touched = {i: 1000 + i for i in range(50)} | {200: 1010, 201: 1005}
    want = sorted(touched, key=lambda i: (-touched[i], i))[:50]
    assert [r.item_id for r in sorted(current, key=lambda r: r.position)] == want


def test_recent_items_expire(spark):
    day = 86400
    batches = [[(1, 1, 5, "click", 0)], [(2, 2, 6, "click", 3 * day)], [(3, 2, 7, "click", 3 * day + 10)]]
    current = io.run_newest(S.recent_items(files(spark, batches)), "recent", ["user_id"]).collect()
    assert [r.item_id for r in current if r.user_id == 1] == [None]
    assert [r.item_id for r in sorted(current, key=lambda r: r.position or 0) if r.user_id == 2] == [7, 6]


def test_update_keeps_last_version(spark):
    stream = files(spark, [[(1, 1, 5, "click", 10)], [(2, 1, 5, "share", 20)]])
    rows = io.run_update(S.trending(stream), "trend", ["window_end", "item_id"]).collect()
    assert {r.score for r in rows} == {4.5} and len(rows) == 12


def test_handler_gets_every_batch(spark):
    stream = files(spark, [[(1, 1, 5, "click", 10)], [(2, 1, 5, "share", 20)]])
    seen = []
    io.run_batches(stream, "handler", lambda batch, batch_id: seen.append((batch_id, batch.count())))
    assert sum(n for _, n in seen) == 2 and len({b for b, _ in seen}) == len(seen)
