"""Stateful streams over several micro-batches and restarts."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import features, ingest
from lodestar.sources.bindings import Tables
from lodestar.sources.storage import new_path
from lodestar.streaming import stateful
from lodestar.streaming.ledger import Ledger

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def bound(spark):
    Tables(spark, "/root/testdata/sf0.001")


def table(spark, rows, columns):
    """Rows end with seconds after T0."""
    made = [(*r[:-1], T0 + dt.timedelta(seconds=r[-1])) for r in rows]
    return spark.createDataFrame(made, f"{columns}, created_at timestamp")


def stream(spark, batches, columns):
    """One file per batch, read one per trigger in order."""
    path = new_path(spark, "input")
    for number, rows in enumerate(batches):
        table(spark, rows, columns).coalesce(1).write.mode("append").parquet(f"{path}/{number}")
    schema = table(spark, [], columns).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(path)


REQUEST = "event_id bigint, api_key string"


def test_rate_limit_rows_equal_the_batch_form(spark):
    rng = random.Random(3)
    rows = [(i, f"k{i % 2}", rng.randrange(0, 3000)) for i in range(200)]
    batches = [rows[i : i + 40] for i in range(0, 200, 40)]
    # A request far ahead closes the windows of the others.
    batches.append([(1000, "z", 100_000)])
    ledger = Ledger(spark, new_path(spark, "limits"))
    ledger.run(stateful.rate_limit_decisions(stream(spark, batches, REQUEST), 5, 600))
    got = {(r.event_id, r.window_index, r.allowed) for r in ledger.read(stateful.DECISIONS).collect()}
    want = ingest.rate_limit(table(spark, rows, REQUEST), 5, 600).collect()
    assert got == {(r.event_id, r.window_index, r.allowed) for r in want}
    assert ledger.read(stateful.DECISIONS).count() == len(rows)


def test_refusals_come_at_once(spark):
    batches = [[(i, "k", 10 + i) for i in range(4)], [(9, "k", 1)]]
    ledger = Ledger(spark, new_path(spark, "limits"))
    ledger.run(stateful.rate_limit_decisions(stream(spark, batches, REQUEST), 2, 600))
    found = sorted(tuple(r) for r in ledger.read("event_id bigint, allowed boolean").select("batch", "event_id", "allowed").collect())
    assert found == [(0, 2, False), (0, 3, False), (1, 1, False)]


def test_values_expire_without_being_deleted(spark):
    hour = 3600
    batches = [
        [("a", "x", 0), ("b", "y", 50)],
        [("c", "z", 1 * hour), ("a", "late", 30)],
        [("c", "z", 2 * hour + 60)],
        [("a", "v", 3 * hour)],
    ]
    columns = "k string, v string"
    schema = "k string, v string, written_us bigint"
    ledger = Ledger(spark, new_path(spark, "ttl"))
    ledger.run(stateful.expiring_values(stream(spark, batches, columns), "k", "v", 2 * hour, "0 seconds"), mode="update")
    # After every batch the newest versions are the batch form at the clock of the batches before it.
    last = max(r.batch for r in ledger.read(schema).select("batch").distinct().collect())
    versions = ledger.read(schema)
    newest = {r.k: r.v for r in ledger.newest(schema, ["k"]).collect() if r.v is not None}
    # A row behind the watermark is dropped.
    rows = [r for b in batches for r in b if r[1] != "late"]
    clock = F.lit(T0 + dt.timedelta(seconds=3 * hour))
    want = features.ttl_lookup(table(spark, rows, columns), "k", "v", clock, 2 * hour)
    assert newest == {r.k: r.v for r in want.collect()} == {"a": "v", "c": "z"}
    gone = {(r.k, r.batch) for r in versions.where("v IS NULL").collect()}
    # The new value of "a" came with the batch in which the old one would have gone.
    assert {k for k, _ in gone} == {"b"} and all(0 < b <= last for _, b in gone)


def test_both_outputs_of_the_repeat_state(spark):
    event = "event_id bigint"
    batches = [[(1, 0), (2, 5), (1, 0)], [(1, 1800), (3, 10)], [(1, 3500), (1, 3700), (2, 4000)], [(1, 7000), (1, 7300)]]
    ledger = Ledger(spark, new_path(spark, "repeats"))
    ledger.run(stateful.deliveries(stream(spark, batches, event), 3600))
    found = ledger.read(stateful.DELIVERIES).collect()
    base = int(T0.timestamp() * 1e6)
    fresh = sorted((r.event_id, (r.created_us - base) // 10**6) for r in found if not r.repeated)
    assert fresh == [(1, 0), (1, 3700), (1, 7300), (2, 5), (2, 4000), (3, 10)]
    assert len(found) == sum(map(len, batches))


def test_errors_count_repeats_like_the_batch_form(spark):
    columns = "event_id bigint, user_id bigint, item_id bigint, event_type string"
    rows = [(1, 1, 1, "click", 0), (1, 1, 1, "click", 20), (2, 1, 1, "click", 400), (3, None, 1, "click", 410), (2, 1, 1, "click", 700)]
    source = stream(spark, [rows[:2], rows[2:4], rows[4:]], columns).withColumn("client_timestamp", F.lit(None).cast("timestamp"))
    found = stateful.count_errors(Ledger(spark, new_path(spark, "errors")), source).collect()
    slot = int(T0.timestamp()) // 300
    assert {(r.slot - slot, r.reason): r.errors for r in found} == {(0, "duplicate"): 1, (1, "missing_id"): 1, (2, "duplicate"): 1}


def test_late_rows_are_kept_apart(spark):
    event = "event_id bigint"
    batches = [[(1, 0), (2, 10_000)], [(3, 100), (4, 9_000)], [(5, 20_000)], [(6, 16_399), (7, 16_400)]]
    ledger = Ledger(spark, new_path(spark, "late"))
    stateful.split_late(ledger, stream(spark, batches, event), 3600)
    late = {r.event_id: r.behind_us for r in ledger.read("event_id bigint, behind_us bigint", "late").collect()}
    on_time = {r.event_id for r in ledger.read("event_id bigint", "on_time").collect()}
    assert late == {3: 6300 * 10**6, 6: 10**6} and on_time == {1, 2, 4, 5, 7}


@pytest.mark.parametrize("moment", ["before the commit", "after the commit"])
def test_stopped_between_batches_and_restarted(spark, moment):
    event = "event_id bigint"
    batches = [[(i, i) for i in range(k, k + 10)] for k in range(0, 40, 10)]
    source = stream(spark, batches, event)
    path = new_path(spark, "restart")

    class Stopping(Ledger):
        def store(self, batch_id, parts, info=None):
            if batch_id == 2 and moment == "before the commit":
                # Half of the batch is written when the query is killed.
                parts["rows"].limit(5).write.parquet(f"{self.path}/data/rows-2-lost")
                raise RuntimeError("killed")
            super().store(batch_id, parts, info)
            if batch_id == 2:
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        Stopping(spark, path).run(source)
    ledger = Ledger(spark, path)
    assert sorted(r.event_id for r in ledger.read(event).collect()) == list(range(20 if "before" in moment else 30))
    ledger.run(source)
    assert sorted(r.event_id for r in ledger.read(event).collect()) == list(range(40))
    ledger.compact(lambda rows: rows.drop("batch"), event)
    assert len(ledger.entries()) == 1 and len(ledger._list(f"{path}/data")) == 1
    assert sorted(r.event_id for r in Ledger(spark, path).read(event).collect()) == list(range(40))
    ledger.run(source)
    assert ledger.read(event).count() == 40


def test_empty_ledger(spark):
    ledger = Ledger(spark, new_path(spark, "none"))
    assert ledger.entries() == [] and ledger.last_batch() == -1 and ledger.read("x int").count() == 0
    ledger.compact(lambda rows: rows.drop("batch"), "x int")


def test_many_keys_share_a_call_of_python(spark):
    # One delivery of many keys, null among them, then one that expires all but the last.
    n, hour = 20_000, 3600
    rows = [(i, f"v{i}", i % 60) for i in range(n)] + [(None, "none", 5), (None, "nil", 3)]
    columns = "k bigint, v string"
    ledger = Ledger(spark, new_path(spark, "many"))
    source = stream(spark, [rows, [(n, "last", 9 * hour)]], columns)
    started = time.monotonic()
    ledger.run(stateful.expiring_values(source, "k", "v", 2 * hour, "0 seconds"), mode="update")
    assert time.monotonic() - started < 40  # a call per key took over a minute
    found = ledger.read("k bigint, v string, written_us bigint")
    assert found.where("batch = 0 AND v IS NOT NULL").count() == n + 1
    assert [r.v for r in found.where("batch = 0 AND k IS NULL").collect()] == ["none"]
    current = ledger.newest("k bigint, v string, written_us bigint", ["k"])
    assert [(r.k, r.v) for r in current.where("v IS NOT NULL").collect()] == [(n, "last")]

    ledger = Ledger(spark, new_path(spark, "many"))
    rows = [(i, 10) for i in range(n)] + [(i, 20) for i in range(0, n, 2)] + [(None, 1), (None, 1), (None, 2)]
    again = [(i, 2 * hour) for i in range(0, n, 5)]
    started = time.monotonic()
    ledger.run(stateful.deliveries(stream(spark, [rows, again], "event_id bigint"), hour, "0 seconds"))
    assert time.monotonic() - started < 40
    told = ledger.read(stateful.DELIVERIES)
    assert told.count() == len(rows) + len(again)
    assert told.where("repeated").count() == n // 2 + 2
    assert sorted((r.created_us % 10**7 // 10**6, r.repeated) for r in told.where("event_id IS NULL").collect()) == [(1, False), (1, True), (2, True)]
