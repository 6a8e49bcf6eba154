"""Structured Streaming runs over the whole event table (available-now trigger)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar import schemas
from lodestar.operators import features, ingest
from lodestar.plans.event_queries import AHEAD_SQL, CLOCK_SQL, us
from lodestar.plans.registry import query
from lodestar.plans.views import weight_sql
from lodestar.sources.bindings import Tables
from lodestar.sources.storage import new_path
from lodestar.streaming import io
from lodestar.streaming import operators as S


def events(t: Tables):
    return io.event_stream(t.spark, t.folder)


@query(
    "event_stream_source",
    "SELECT event_id, user_id, item_id, event_type, epoch_us(created_at) AS created_us FROM interactions",
)
def _(t: Tables):
    # Through the wire format: encoded as messages, decoded by schema.
    stream = events(t).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    messages = ingest.encode_json(stream, "user_id", schemas.EVENT)
    rows = io.run_append(io.decoded(messages), "decoded")
    return rows.select("event_id", "user_id", "item_id", "event_type", us("created_at", "created_us"))


@query("dedupe_stream", "SELECT event_id, user_id FROM interactions")
def _(t: Tables):
    stream = events(t)
    again = events(t).filter("event_id % 20 = 0").withColumn(
        "created_at", F.expr("created_at + interval 30 minutes")
    )
    return io.run_append(S.dedupe(stream.unionByName(again)).select("event_id", "user_id"), "deduped")


@query(
    "trending_stream",
    f"""
weighted AS (SELECT item_id, {weight_sql()} AS w, epoch_us(created_at) AS us FROM interactions WHERE {weight_sql()} > 0),
spread AS (SELECT item_id, w, (us // 300000000 + 1 + k) * 300000000 AS end_us
  FROM weighted CROSS JOIN (SELECT unnest(range(0, 12)) AS k))
---
SELECT end_us::BIGINT AS end_us, item_id, sum(w) AS score FROM spread GROUP BY end_us, item_id
""",
)
def _(t: Tables):
    rows = io.run_update(S.trending(events(t)), "trending", ["window_end", "item_id"])
    return rows.select(us("window_end", "end_us"), "item_id", "score")


@query(
    "recent_items_stream",
    f"""
SELECT user_id, item_id, epoch_us(touched_at) AS touched_us, position::INTEGER AS position FROM (
  SELECT user_id, item_id, max(created_at) AS touched_at, row_number() OVER (
    PARTITION BY user_id ORDER BY max(created_at) DESC, item_id) AS position
  FROM interactions GROUP BY user_id, item_id) WHERE position <= {C.RECENT_ITEMS_LIMIT}
  -- Lists whose newest touch is older than their lifetime at the watermark have expired.
  AND user_id IN (SELECT user_id FROM interactions GROUP BY user_id
    HAVING epoch_ms(max(created_at)) + {C.RECENT_ITEMS_TTL_SECONDS * 1000} > (SELECT epoch_ms(max(created_at))
      - epoch_ms(INTERVAL '{S.LATENESS}') FROM interactions))
""",
)
def _(t: Tables):
    stream = S.recent_items(events(t))
    current = io.run_newest(stream, "recent", ["user_id"])
    return current.filter("item_id IS NOT NULL")


@query("unique_viewers_stream")
def _(t: Tables):
    daily = io.run_update(S.unique_viewers(events(t)), "viewers", ["day", "item_id"])
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return daily.groupBy("item_id").agg(merged.alias("viewers"))


@query(
    "unique_viewers_stream_bound",
    "SELECT item_id, count(DISTINCT user_id) AS viewers, true AS within, true AS as_batch FROM interactions GROUP BY item_id",
)
def _(t: Tables):
    # The stream's daily sketches, merged, against the exact counts and against the batch's merged sketches.
    daily = io.run_update(S.unique_viewers(events(t)), "viewers", ["day", "item_id"])
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    streamed = daily.groupBy("item_id").agg(merged.alias("viewers"))
    batch = features.unique_viewers_hll(features.unique_viewers_sketch(t.interactions))
    checked = features.sketch_check(streamed, features.unique_viewers_exact(t.interactions))
    both = streamed.join(batch.withColumnRenamed("viewers", "in_batch"), "item_id")
    same = both.select("item_id", (F.abs(F.col("viewers") - F.col("in_batch")) <= 1).alias("as_batch"))
    return checked.join(same, "item_id")


@query(
    "events_consumed_stream",
    """
SELECT (epoch_us(created_at) // 300000000 * 300000000)::BIGINT AS window_us, event_type, count(*) AS events
FROM interactions GROUP BY ALL
""",
)
def _(t: Tables):
    rows = io.run_update(S.consumed(events(t)), "consumed", ["window_start", "event_type"])
    return rows.select(us("window_start", "window_us"), "event_type", "events")


@query(
    "rate_limit_stream",
    """
SELECT (epoch_us(created_at) // 3600000000 * 3600000000)::BIGINT AS window_us, api_key, count(*) AS requests,
  greatest(count(*) - 5, 0) AS rejected FROM interactions GROUP BY 1, 2
""",
)
def _(t: Tables):
    limited = S.rate_limit(events(t), 5, "1 hour")
    rows = io.run_update(limited, "limits", ["window_start", "api_key"])
    return rows.select(us("window_start", "window_us"), "api_key", "requests", "rejected")


@query(
    "pipeline_lag_stream",
    """
SELECT (epoch_us(created_at) // 300000000 * 300000000)::BIGINT AS window_us, epoch_us(max(created_at)) AS newest_us
FROM interactions GROUP BY 1
""",
)
def _(t: Tables):
    rows = io.run_update(S.newest(events(t)), "lag", ["window_start"])
    return rows.select(us("window_start", "window_us"), us("newest", "newest_us"))


@query("late_events", f"SELECT event_id, user_id FROM interactions WHERE {CLOCK_SQL}")
def _(t: Tables):
    return io.run_append(S.on_time(events(t)).select("event_id", "user_id"), "on-time")


@query(
    "session_stream",
    f"""
marked AS (SELECT user_id, created_at, CASE WHEN lag(created_at) OVER w IS NULL
    OR epoch_us(created_at) - epoch_us(lag(created_at) OVER w) >= {C.SESSION_GAP_SECONDS * 10**6}
    THEN 1 ELSE 0 END AS fresh
  FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY created_at)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at
    ROWS UNBOUNDED PRECEDING) AS no FROM marked)
---
SELECT user_id, epoch_us(min(created_at)) AS start_us, epoch_us(max(created_at)) + 900000000 AS end_us,
  count(*) AS events
FROM numbered GROUP BY user_id, no
HAVING epoch_us(max(created_at)) + 900000000 <= (SELECT epoch_us(max(created_at)) // 1000 * 1000 - 3600000000 FROM interactions)
""",
)
def _(t: Tables):
    rows = io.run_append(S.sessions(events(t)), "sessions")
    return rows.select("user_id", us("session_start", "start_us"), us("session_end", "end_us"), "events")


@query(
    "dead_letter_stream",
    f"""
SELECT CASE WHEN {AHEAD_SQL} > {C.MAX_CLOCK_SKEW_SECONDS * 10**6} THEN 'future'
  WHEN -{AHEAD_SQL} > {C.MAX_EVENT_AGE_SECONDS * 10**6} THEN 'expired' ELSE 'valid' END AS reason,
  count(*) AS n, sum(event_id)::BIGINT AS ids
FROM interactions GROUP BY 1
""",
)
def _(t: Tables):
    valid, bad = new_path(t.spark, "valid"), new_path(t.spark, "quarantine")
    stream = events(t).select(*schemas.EVENT.fieldNames())
    io.run_batches(stream, "split", S.split_handler(valid, bad))
    kept = t.spark.read.schema("event_id bigint").parquet(valid).select("event_id", F.lit("valid").alias("reason"))
    refused = t.spark.read.schema("event_id bigint, reason string").parquet(bad)
    both = kept.unionByName(refused.select("event_id", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "event_fanout_stream",
    """
SELECT 'user-events' AS topic, user_id AS key, count(*) AS n FROM interactions GROUP BY user_id
UNION ALL SELECT 'item-events', item_id, count(*) FROM interactions GROUP BY item_id
""",
)
def _(t: Tables):
    paths = {topic: new_path(t.spark, topic) for topic in ("user-events", "item-events")}
    stream = events(t).select(*schemas.EVENT.fieldNames())
    io.run_batches(stream, "fan-out", S.fan_out_handler(paths))
    schema = "topic string, key bigint, event_id bigint"
    users, items = [t.spark.read.schema(schema).parquet(p) for p in paths.values()]
    return users.unionByName(items).groupBy("topic", "key").agg(F.count("*").alias("n"))


@query(
    "audit_log_stream",
    "SELECT strftime(created_at, '%Y-%m') AS event_month, count(*) AS n, sum(event_id)::BIGINT AS ids "
    "FROM interactions GROUP BY ALL",
)
def _(t: Tables):
    path = new_path(t.spark, "audit")
    stream = events(t).select("event_id", "user_id", "item_id", "event_type", "created_at")
    io.run_batches(stream, "audit", S.audit_handler(path))
    log = t.spark.read.schema("event_id bigint, event_month string").parquet(path)
    return log.groupBy("event_month").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "custom_handler",
    "SELECT event_id, dwell_ms FROM interactions WHERE event_type = 'dwell' AND dwell_ms > 10000",
)
def _(t: Tables):
    # Any function of (batch, batch id) can be plugged in.
    path = new_path(t.spark, "long-dwells")

    def keep_long_dwells(batch, batch_id):
        long = batch.filter("event_type = 'dwell' AND dwell_ms > 10000").select("event_id", "dwell_ms")
        long.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    io.run_batches(events(t), "handler", keep_long_dwells)
    return t.spark.read.schema("event_id bigint, dwell_ms int").parquet(path).select("event_id", "dwell_ms")
