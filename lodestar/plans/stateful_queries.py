"""Streams whose state decides about single rows, fed in several deliveries with a restart after each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.plans.event_queries import AHEAD_SQL, CLOCK_SQL, DEDUPE_CTE, us
from lodestar.plans.registry import query
from lodestar.sources.bindings import Tables
from lodestar.sources.storage import new_path
from lodestar.streaming import stateful
from lodestar.streaming.ledger import Ledger

#: Weeks of the event table, each a delivery; every seventh event of a week comes with the next one.
DELIVERIES = 6
_WEEK_US = 7 * 86400 * 10**6
_WEEK_SQL = f"(epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // {_WEEK_US}"


def _week() -> Column:
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return F.floor((F.unix_micros("created_at") - start) / F.lit(_WEEK_US)).cast("int")


def _in_turns(events: DataFrame, turn: Column, run: Callable[[DataFrame], object]) -> None:
    """Deliver ``events`` turn by turn into a folder, and run the stream over it after each, from where it stopped."""
    spark = events.sparkSession
    folder = new_path(spark, "deliveries")
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    marked = timed.withColumn("turn", F.least(F.greatest(turn, F.lit(0)), F.lit(DELIVERIES - 1)))
    for number in range(DELIVERIES):
        marked.where(F.col("turn") == number).drop("turn").write.mode("append").parquet(folder)
        # One batch per delivery.
        source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1_000_000).parquet(folder)
        run(source)


def _shuffled_week() -> Column:
    return _week() + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)


@query(
    "event_stream_resumed",
    "SELECT event_id, user_id, item_id, event_type, epoch_us(created_at) AS created_us FROM interactions",
)
def _(t: Tables):
    ledger = Ledger(t.spark, new_path(t.spark, "resumed"))
    columns = ["event_id", "user_id", "item_id", "event_type", "created_at"]
    _in_turns(t.interactions.select(*columns), _shuffled_week(), ledger.run)
    schema = "event_id bigint, user_id bigint, item_id bigint, event_type string, created_at timestamp"
    ledger.compact(lambda rows: rows.drop("batch"), schema)
    rows = ledger.read(schema)
    return rows.select("event_id", "user_id", "item_id", "event_type", us("created_at", "created_us"))


@query(
    "rate_limit_decisions_stream",
    """
ranked AS (SELECT event_id, api_key, CAST(floor(epoch_us(created_at) / 3600000000) AS BIGINT) AS window_index,
  row_number() OVER (PARTITION BY api_key, floor(epoch_us(created_at) / 3600000000) ORDER BY created_at, event_id) <= 5 AS allowed
  FROM interactions)
---
SELECT event_id, api_key, window_index, allowed FROM ranked
-- Windows that the watermark has not closed have refused requests only.
WHERE NOT allowed OR (window_index + 1) * 3600000 < (SELECT epoch_ms(max(created_at)) FROM interactions) - 8 * 86400000
""",
)
def _(t: Tables):
    ledger = Ledger(t.spark, new_path(t.spark, "limits"))
    requests = t.interactions.select("event_id", "api_key", "created_at")

    def run(source: DataFrame) -> None:
        ledger.run(stateful.rate_limit_decisions(source, 5, 3600, "8 days"))

    _in_turns(requests, _shuffled_week(), run)
    return ledger.read(stateful.DECISIONS).select("event_id", "api_key", "window_index", "allowed")


_TTL_HOURS = 6


@query(
    "ttl_lookup_stream",
    f"""
SELECT user_id, max_by(used, (epoch_us(created_at), used)) AS device_used, epoch_us(max(created_at)) AS written_us
FROM (SELECT user_id, created_at, device || event_type AS used FROM interactions) GROUP BY user_id
HAVING (epoch_us(max(created_at)) + {_TTL_HOURS * 3600 * 10**6}) // 1000
  >= (SELECT epoch_ms(max(created_at)) FROM interactions) - 3600000
""",
)
def _(t: Tables):
    ledger = Ledger(t.spark, new_path(t.spark, "ttl"))
    log = t.interactions.select("user_id", "created_at", F.concat("device", "event_type").alias("device_used"))
    schema = "user_id bigint, device_used string, written_us bigint"

    def run(source: DataFrame) -> None:
        ledger.run(stateful.expiring_values(source, "user_id", "device_used", _TTL_HOURS * 3600), mode="update")
        # Readers go over one version per user and the batches of one delivery.
        ledger.compact(lambda rows: ledger.newest(schema, ["user_id"]), schema)

    _in_turns(log, _week(), run)
    return ledger.newest(schema, ["user_id"]).where(F.col("written_us").isNotNull())


@query(
    "ingestion_error_stream",
    f"""
valid_replay AS (SELECT * FROM event_replay WHERE {CLOCK_SQL}),
{DEDUPE_CTE.replace('event_replay', 'valid_replay')},
refused AS (
  SELECT epoch_us(created_at) // 300000000 AS slot, CASE WHEN {AHEAD_SQL} > 0 THEN 'future' ELSE 'expired' END AS reason,
    count(*) AS errors FROM event_replay WHERE NOT {CLOCK_SQL} GROUP BY 1, 2
  UNION ALL
  SELECT slot, 'duplicate', n - coalesce(kept, 0) FROM
    (SELECT epoch_us(created_at) // 300000000 AS slot, count(*) AS n FROM valid_replay GROUP BY 1)
    LEFT JOIN (SELECT epoch_us(taken) // 300000000 AS slot, count(*) AS kept FROM accepted GROUP BY 1)
    USING (slot) WHERE n > coalesce(kept, 0))
---
SELECT (slot * 300000000)::BIGINT AS window_us, reason, errors, errors / 300.0::DOUBLE AS rate,
  errors / 300.0::DOUBLE > {C.ERROR_RATE_ALERT} AS alert FROM refused
""",
)
def _(t: Tables):
    ledger = Ledger(t.spark, new_path(t.spark, "errors"))
    columns = ["event_id", "user_id", "item_id", "event_type", "client_timestamp", "created_at"]
    found: list[DataFrame] = []
    _in_turns(
        t.event_replay.select(*columns), _week(), lambda source: found.append(stateful.count_errors(ledger, source))
    )
    window = (F.col("slot") * 300_000_000).alias("window_us")
    return found[-1].select(window, "reason", "errors", "rate", "alert")


@query(
    "late_events_split",
    f"""
delivered AS (SELECT event_id, epoch_us(created_at) AS us,
  least({_WEEK_SQL} + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, {DELIVERIES - 1}) AS turn FROM interactions),
newest AS (SELECT turn, max(us) AS us FROM delivered GROUP BY turn),
marks AS (SELECT n.turn, max(b.us) - 3600000000 AS mark FROM newest n LEFT JOIN newest b ON b.turn < n.turn GROUP BY n.turn)
---
SELECT event_id, coalesce(us < mark, false) AS late, CASE WHEN us < mark THEN mark - us END AS behind_us
FROM delivered JOIN marks USING (turn)
""",
)
def _(t: Tables):
    ledger = Ledger(t.spark, new_path(t.spark, "late"))
    _in_turns(
        t.interactions.select("event_id", "created_at"),
        _shuffled_week(),
        lambda source: stateful.split_late(ledger, source, 3600),
    )
    on_time = ledger.read("event_id bigint, created_at timestamp", "on_time")
    late = ledger.read("event_id bigint, created_at timestamp, behind_us bigint", "late")
    return on_time.select("event_id", F.lit(False).alias("late"), F.lit(None).cast("bigint").alias("behind_us")).unionAll(
        late.select("event_id", F.lit(True), "behind_us")
    )
