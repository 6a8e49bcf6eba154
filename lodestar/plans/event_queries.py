"""Sources, sinks, validation and routing of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar import schemas
from lodestar.functions import events as E
from lodestar.operators import features, ingest, monitoring
from lodestar.plans.registry import query
from lodestar.plans.views import HOLDOUT_SQL, IMPRESSION_SQL, NOW_SQL, sql_in, sql_list, weight_sql
from lodestar.sources import event_log
from lodestar.sources.bindings import Tables, holdout_start, now
from lodestar.sources.storage import new_path

KNOWN_SQL = f"event_type IN {sql_in(C.EVENT_TYPES)}"
AHEAD_SQL = "(epoch_us(client_timestamp) - epoch_us(created_at))"
CLOCK_SQL = (
    f"(client_timestamp IS NULL OR ({AHEAD_SQL} <= {C.MAX_CLOCK_SKEW_SECONDS * 10**6} "
    f"AND -{AHEAD_SQL} <= {C.MAX_EVENT_AGE_SECONDS * 10**6}))"
)


def us(column: str, alias: str | None = None):
    """Timestamp as microseconds, the form both engines print alike."""
    return E.micros(F.col(column)).alias(alias or column)


@query(
    "write_training_snapshot",
    """
SELECT strftime(created_at, '%Y-%m-%d') AS dt, count(*) AS n, sum(event_id)::BIGINT AS ids
FROM interactions GROUP BY ALL
""",
)
def _(t: Tables):
    path = new_path(t.spark, "snapshot")
    columns = t.interactions.select("event_id", "user_id", "item_id", "event_type", "created_at")
    event_log.write_training_snapshot(columns, path)
    back = event_log.read_snapshot(t.spark, path, columns.schema)
    return back.groupBy("dt").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "interactions_by_month",
    """
SELECT strftime(created_at, '%Y-%m') AS event_month, count(*) AS n
FROM (SELECT created_at FROM interactions UNION ALL SELECT created_at FROM purchases)
GROUP BY ALL
""",
)
def _(t: Tables):
    both = t.interactions.select("created_at").unionByName(t.purchases.select("created_at"))
    return event_log.with_month(both).groupBy("event_month").agg(F.count("*").alias("n"))


@query(
    "event_json_roundtrip",
    """
SELECT event_id, user_id, item_id, event_type, coalesce(dwell_ms, -1) AS dwell_ms, device,
  coalesce(epoch_us(client_timestamp), -1) AS client_us, epoch_us(created_at) AS created_us
FROM interactions
""",
)
def _(t: Tables):
    messages = ingest.encode_json(t.interactions, "user_id", schemas.EVENT)
    back = ingest.decode_json(messages, schemas.EVENT)
    return back.select(
        "event_id",
        "user_id",
        "item_id",
        "event_type",
        F.coalesce("dwell_ms", F.lit(-1)).alias("dwell_ms"),
        "device",
        F.coalesce(us("client_timestamp"), F.lit(-1)).alias("client_us"),
        us("created_at", "created_us"),
    )


@query(
    "event_fanout",
    """
SELECT 'user-events' AS topic, user_id AS key, event_id, event_type FROM interactions
UNION ALL SELECT 'item-events', item_id, event_id, event_type FROM interactions
""",
)
def _(t: Tables):
    return ingest.fan_out(t.interactions).select("topic", "key", "event_id", "event_type")


@query(
    "dead_letter_split",
    f"""
SELECT reason, count(*) AS n, sum(raw_id)::BIGINT AS ids FROM (
  SELECT event_id AS raw_id, CASE
    WHEN event_id % 50 = 7 THEN 'malformed'
    WHEN event_id % 50 = 9 THEN 'unknown_type'
    WHEN {AHEAD_SQL} > {C.MAX_CLOCK_SKEW_SECONDS * 10**6} THEN 'future'
    WHEN -{AHEAD_SQL} > {C.MAX_EVENT_AGE_SECONDS * 10**6} THEN 'expired'
    ELSE 'valid' END AS reason
  FROM interactions)
GROUP BY reason
""",
)
def _(t: Tables):
    # Every 50th message is cut off after its first character, another carries
    # a type nobody knows.
    kind = F.when(F.col("event_id") % 50 == 9, "poke").otherwise(F.col("event_type"))
    typed = t.interactions.withColumn("raw_id", F.col("event_id")).withColumn("event_type", kind)
    body = F.to_json(F.struct(*schemas.EVENT.fieldNames()))
    messages = typed.select(
        "raw_id", F.when(F.col("raw_id") % 50 == 7, "{").otherwise(body).alias("value")
    )
    decoded = messages.select("raw_id", F.from_json("value", schemas.EVENT).alias("e")).select(
        "raw_id", "e.*"
    )
    valid, quarantine = ingest.dead_letter_split(decoded)
    both = valid.select("raw_id", F.lit("valid").alias("reason")).unionByName(
        quarantine.select("raw_id", "reason")
    )
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("raw_id").alias("ids"))


@query(
    "interaction_audit_append",
    """
SELECT strftime(created_at, '%Y-%m') AS event_month, count(*) AS n, sum(event_id)::BIGINT AS ids
FROM interactions GROUP BY ALL
""",
)
def _(t: Tables):
    path = new_path(t.spark, "audit-log")
    rows = t.interactions.select("event_id", "user_id", "item_id", "event_type", "created_at")
    event_log.append_new_events(t.spark, rows.filter("event_id % 3 < 2"), path)
    # The second batch overlaps the first, as a retried delivery does.
    event_log.append_new_events(t.spark, rows.filter("event_id % 3 > 0"), path)
    log = t.spark.read.schema(event_log.with_month(rows).schema).parquet(path)
    return log.groupBy("event_month").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "embedded_items",
    "SELECT item_id, category, CAST(len(embedding) AS INTEGER) AS dim FROM items WHERE embedding IS NOT NULL",
)
def _(t: Tables):
    return features.embedded_items(t.items).select(
        "item_id", "category", F.size("embedding").alias("dim")
    )


@query(
    "feedback_ingest",
    f"""
scores AS (SELECT item_id, sum({weight_sql()}) AS score FROM interactions
  WHERE created_at < {NOW_SQL} GROUP BY item_id),
latest AS (SELECT item_id, arg_max(event_type, epoch_us(created_at)) AS last_feedback
  FROM interactions WHERE event_type IN ('share', 'save', 'report', 'hide')
    AND created_at <= {NOW_SQL} AND created_at > {NOW_SQL} - INTERVAL 7 DAY GROUP BY item_id)
---
SELECT item_id, CASE WHEN last_feedback IN ('report', 'hide') THEN -1.0::DOUBLE ELSE score END AS score,
  coalesce(last_feedback IN ('report', 'hide'), false) AS suppressed
FROM scores LEFT JOIN latest USING (item_id)
""",
)
def _(t: Tables):
    kinds = ["share", "save", "report", "hide"]
    weight = E.signal_weight(F.col("event_type"))
    scores = (
        t.interactions.filter(F.col("created_at") < now())
        .groupBy("item_id")
        .agg(F.sum(weight).alias("score"))
    )
    feedback = t.interactions.filter(F.col("event_type").isin(kinds))
    return ingest.feedback_override(scores, feedback, now(), ttl_seconds=7 * 86400)


@query(
    "event_type_validate",
    f"SELECT event_id, event_type FROM interactions WHERE {KNOWN_SQL} "
    "AND user_id IS NOT NULL AND item_id IS NOT NULL",
)
def _(t: Tables):
    return ingest.validate_event_type(t.interactions).select("event_id", "event_type")


@query("signal_weight", f"SELECT event_id, {weight_sql()} AS weight FROM interactions")
def _(t: Tables):
    return t.interactions.select("event_id", E.signal_weight(F.col("event_type")).alias("weight"))


@query(
    "negative_event_flag",
    f"SELECT event_id, event_type IN {sql_in(C.NEGATIVE_EVENTS)} AS negative FROM interactions",
)
def _(t: Tables):
    return t.interactions.select("event_id", E.is_negative(F.col("event_type")).alias("negative"))


@query("timestamp_gate", f"SELECT event_id, user_id FROM interactions WHERE {CLOCK_SQL}")
def _(t: Tables):
    return ingest.timestamp_gate(t.interactions).select("event_id", "user_id")


DEDUPE_CTE = f"""
accepted AS (
  SELECT event_id, min(created_at) AS taken FROM event_replay GROUP BY event_id
  UNION ALL
  SELECT r.event_id, min(r.created_at) FROM accepted a JOIN event_replay r
    ON r.event_id = a.event_id AND r.created_at >= a.taken + to_seconds({C.DEDUPE_TTL_SECONDS})
  GROUP BY r.event_id, a.taken)"""


@query("dedupe_events", f"{DEDUPE_CTE}\n---\nSELECT event_id, epoch_us(taken) AS created_us FROM accepted")
def _(t: Tables):
    accepted = ingest.dedupe_events(t.event_replay)
    return accepted.select("event_id", us("created_at", "created_us"))


@query(
    "rate_limit",
    """
SELECT event_id, api_key, CAST(floor(epoch_us(created_at) / 3600000000) AS BIGINT) AS window_index,
  row_number() OVER (PARTITION BY api_key, floor(epoch_us(created_at) / 3600000000)
    ORDER BY created_at, event_id) <= 5 AS allowed
FROM interactions
""",
)
def _(t: Tables):
    limited = ingest.rate_limit(t.interactions, limit=5, window_seconds=3600)
    return limited.select("event_id", "api_key", "window_index", "allowed")


@query(
    "rate_limit_rejections",
    f"""
ranked AS (SELECT created_at, row_number() OVER (
    PARTITION BY api_key, floor(epoch_us(created_at) / 3600000000) ORDER BY created_at, event_id) AS n
  FROM interactions)
---
SELECT CAST(floor(epoch_us(created_at) / 300000000) AS BIGINT) AS slot,
  count(*) FILTER (n > 5) AS rejected, count(*) AS requests,
  count(*) FILTER (n > 5) / 300.0::DOUBLE > {C.REJECTION_RATE_ALERT} AS alert
FROM ranked GROUP BY slot
""",
)
def _(t: Tables):
    limited = ingest.rate_limit(t.interactions, limit=5, window_seconds=3600)
    return ingest.rate_limit_rejections(limited)


@query(
    "sustained_rejections",
    """
ranked AS (SELECT created_at, row_number() OVER (
    PARTITION BY api_key, floor(epoch_us(created_at) / 3600000000) ORDER BY created_at, event_id) AS n
  FROM interactions),
slots AS (SELECT CAST(floor(epoch_us(created_at) / 300000000) AS BIGINT) AS slot,
  count(*) FILTER (n > 5) / 300.0::DOUBLE > 0.004 AS alert FROM ranked GROUP BY slot)
---
SELECT slot, alert, count(*) FILTER (alert) OVER (ORDER BY slot RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS sustained
FROM slots
""",
)
def _(t: Tables):
    # Two five-minute slots in a row, at a threshold that this traffic reaches.
    limited = ingest.rate_limit(t.interactions, limit=5, window_seconds=3600)
    slots = ingest.rate_limit_rejections(limited, alert=0.004).withColumn("rule", F.lit("rejections"))
    return monitoring.sustained_alerts(slots, ["rule"], 2).select("slot", "alert", "sustained")


@query(
    "feedback_union",
    """
SELECT event_type, count(*) AS n, count(dwell_ms) AS with_dwell FROM (
  SELECT event_type, dwell_ms FROM interactions WHERE event_type NOT IN ('hide', 'report')
  UNION ALL SELECT event_type, NULL FROM interactions WHERE event_type IN ('hide', 'report')) GROUP BY event_type
""",
)
def _(t: Tables):
    # Explicit feedback arrives with fewer columns than the behavioural log.
    explicit = F.col("event_type").isin(C.SUPPRESSING_EVENTS)
    feedback = t.interactions.filter(explicit).select("event_id", "user_id", "item_id", "event_type", "created_at")
    union = ingest.feedback_interactions(feedback, t.interactions.filter(~explicit))
    return union.groupBy("event_type").agg(F.count("*").alias("n"), F.count("dwell_ms").alias("with_dwell"))


@query(
    "ingestion_error_rate",
    f"""
{DEDUPE_CTE.replace('event_replay', 'valid_replay')},
errors AS (
  SELECT floor(epoch_us(created_at) / 300000000) AS slot, 'invalid' AS reason, count(*) AS errors
  FROM event_replay WHERE NOT {CLOCK_SQL} GROUP BY 1
  UNION ALL
  SELECT slot, 'duplicate', n - coalesce(kept, 0) FROM
    (SELECT floor(epoch_us(created_at) / 300000000) AS slot, count(*) AS n FROM valid_replay GROUP BY 1)
    LEFT JOIN (SELECT floor(epoch_us(taken) / 300000000) AS slot, count(*) AS kept FROM accepted GROUP BY 1)
    USING (slot) WHERE n > coalesce(kept, 0))
---
SELECT CAST(slot AS BIGINT) AS slot, reason, errors, errors / 300.0::DOUBLE AS rate,
  errors / 300.0::DOUBLE > {C.ERROR_RATE_ALERT} AS alert FROM errors
""".replace(
        "\naccepted AS", f"valid_replay AS (SELECT * FROM event_replay WHERE {CLOCK_SQL}),\naccepted AS"
    ),
)
def _(t: Tables):
    valid, _ = ingest.dead_letter_split(t.event_replay)
    return ingest.ingestion_errors(t.event_replay, ingest.dedupe_events(valid))


@query(
    "sessionize",
    f"""
marked AS (SELECT user_id, created_at, CASE WHEN lag(created_at) OVER w IS NULL
    OR epoch_us(created_at) - epoch_us(lag(created_at) OVER w) >= {C.SESSION_GAP_SECONDS * 10**6}
    THEN 1 ELSE 0 END AS fresh
  FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY created_at)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at
    ROWS UNBOUNDED PRECEDING) AS no FROM marked)
---
SELECT user_id, CAST(no AS BIGINT) AS session_no, epoch_us(min(created_at)) AS start_us,
  epoch_us(max(created_at)) AS end_us, count(*) AS events
FROM numbered GROUP BY user_id, no
""",
)
def _(t: Tables):
    sessions = ingest.sessionize(t.interactions, ["user_id"])
    return sessions.select(
        "user_id", "session_no", us("session_start", "start_us"), us("session_end", "end_us"), "events"
    )


@query(
    "sessionize_global",
    f"""
marked AS (SELECT created_at, CASE WHEN lag(created_at) OVER w IS NULL
    OR epoch_us(created_at) - epoch_us(lag(created_at) OVER w) >= {C.SESSION_GAP_SECONDS * 10**6}
    THEN 1 ELSE 0 END AS fresh FROM interactions WINDOW w AS (ORDER BY created_at)),
numbered AS (SELECT *, sum(fresh) OVER (ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS no FROM marked)
---
SELECT CAST(no AS BIGINT) AS session_no, epoch_us(min(created_at)) AS start_us,
  epoch_us(max(created_at)) AS end_us, count(*) AS events
FROM numbered GROUP BY no
""",
)
def _(t: Tables):
    sessions = ingest.sessionize(t.interactions, [])
    return sessions.select(
        "session_no", us("session_start", "start_us"), us("session_end", "end_us"), "events"
    )


@query(
    "pipeline_lag",
    f"""
SELECT greatest((epoch_us({NOW_SQL}) - epoch_us(max(created_at))) / 1e6::DOUBLE, 0) AS lag_seconds,
  greatest((epoch_us({NOW_SQL}) - epoch_us(max(created_at))) / 1e6::DOUBLE, 0) > {C.LAG_ALERT_SECONDS} AS alert
FROM interactions
""",
)
def _(t: Tables):
    return ingest.pipeline_lag(t.interactions, now())


@query(
    "events_consumed_by_type",
    """
SELECT CAST(floor(epoch_us(created_at) / 300000000) AS BIGINT) AS slot, event_type, count(*) AS events
FROM interactions GROUP BY ALL
""",
)
def _(t: Tables):
    return ingest.consumed_by_type(t.interactions)


@query(
    "training_window",
    f"""
SELECT event_id, user_id, item_id FROM interactions
WHERE created_at >= {HOLDOUT_SQL} AND created_at < {NOW_SQL}
""",
)
def _(t: Tables):
    logged = event_log.with_month(t.interactions)
    return event_log.month_range(logged, holdout_start(), now()).select(
        "event_id", "user_id", "item_id"
    )


@query(
    "impression_counts",
    f"SELECT item_id, count(*) AS impression_count FROM interactions WHERE {IMPRESSION_SQL} GROUP BY item_id",
)
def _(t: Tables):
    return features.impression_counts(t.interactions)
