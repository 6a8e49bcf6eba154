"""Stream-to-stream transformations; column logic is shared with the batch forms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.operators import ingest
from lodestar.sources import event_log
from lodestar.streaming.io import Handler

LATENESS = "1 hour"


def dedupe(events: DataFrame, delay: str = LATENESS) -> DataFrame:
    """First delivery of an event_id; repeats within the delay are dropped."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def trending(events: DataFrame, horizon: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Positive signal per item over a sliding horizon."""
    weight = E.signal_weight(F.col("event_type"))
    return (
        events.filter(weight > 0)
        .withWatermark("created_at", LATENESS)
        .groupBy(F.window("created_at", horizon, slide).alias("w"), "item_id")
        .agg(F.sum(weight).alias("score"))
        .select(F.col("w.end").alias("window_end"), "item_id", "score")
    )


def unique_viewers(events: DataFrame) -> DataFrame:
    """Mergeable sketch of an item's viewers per day."""
    return (
        events.withWatermark("created_at", LATENESS)
        .groupBy(F.window("created_at", "1 day").alias("w"), "item_id")
        .agg(F.hll_sketch_agg("user_id").alias("sketch"))
        .select(F.col("w.start").alias("day"), "item_id", "sketch")
    )


def consumed(events: DataFrame, length: str = "5 minutes") -> DataFrame:
    return (
        events.withWatermark("created_at", LATENESS)
        .groupBy(F.window("created_at", length).alias("w"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events")
    )


def errors(events: DataFrame, length: str = "5 minutes") -> DataFrame:
    """Refused events per reason and window, with the alert flag."""
    refused = events.withColumn("reason", ingest.rejection_reason()).filter("reason IS NOT NULL")
    return (
        refused.withWatermark("created_at", LATENESS)
        .groupBy(F.window("created_at", length).alias("w"), "reason")
        .agg(F.count("*").alias("errors"))
        .select(
            F.col("w.start").alias("window_start"),
            "reason",
            "errors",
            (F.col("errors") / 300.0 > C.ERROR_RATE_ALERT).alias("alert"),
        )
    )


def rate_limit(events: DataFrame, limit: int, length: str) -> DataFrame:
    """Requests and rejections per key and fixed window."""
    rejected = F.greatest(F.col("requests") - limit, F.lit(0))
    return (
        events.withWatermark("created_at", LATENESS)
        .groupBy(F.window("created_at", length).alias("w"), "api_key")
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), "api_key", "requests", rejected.alias("rejected"))
    )


def newest(events: DataFrame, length: str = "5 minutes") -> DataFrame:
    """Newest event time per window: what lag is measured from."""
    return (
        events.withWatermark("created_at", LATENESS)
        .groupBy(F.window("created_at", length).alias("w"))
        .agg(F.max("created_at").alias("newest"))
        .select(F.col("w.start").alias("window_start"), "newest")
    )


def sessions(events: DataFrame, gap: str = "15 minutes", delay: str = LATENESS) -> DataFrame:
    """Closed sessions per user."""
    return (
        events.withWatermark("created_at", delay)
        .groupBy(F.session_window("created_at", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    )


def on_time(events: DataFrame) -> DataFrame:
    """Events whose client clock is plausible; too-old ones are refused, not merged."""
    return ingest.timestamp_gate(events)


def split_handler(valid_path: str, quarantine_path: str) -> Handler:
    """Write valid and quarantined rows of a batch to two places."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        valid, bad = ingest.dead_letter_split(batch)
        valid.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")

    return handle


def fan_out_handler(paths: dict[str, str]) -> Handler:
    """Write each topic of the fan-out to its own place."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = ingest.fan_out(batch)
        for topic, path in paths.items():
            rows = routed.filter(F.col("topic") == topic)
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def audit_handler(path: str) -> Handler:
    """Append accepted events to the durable log; repeated batches add nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        event_log.append_new_events(batch.sparkSession, batch, path)

    return handle


RECENT_OUTPUT = "user_id bigint, item_id bigint, touched_us bigint, position int"
RECENT_STATE = "items array<bigint>, touched array<bigint>"


def recent_items(
    events: DataFrame,
    limit: int = C.RECENT_ITEMS_LIMIT,
    ttl_seconds: int = C.RECENT_ITEMS_TTL_SECONDS,
) -> DataFrame:
    """Per user the last distinct items; the state expires a day after the last event.

    A batch is folded frame by frame and the state never holds more than
    ``limit`` items. Each update emits the user's whole new list, which replaces
    the one of an earlier batch; an expired user gets one row without an item.
    """
    ttl_ms = ttl_seconds * 1000

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "item_id": [None], "touched_us": [None], "position": [None]})
            return
        latest: dict[int, int] = {}
        if state.exists:
            items, touched = state.get
            latest = dict(zip(items, touched))
        for frame in frames:
            for item, at in frame.groupby("item_id")["touched_us"].max().items():
                latest[int(item)] = max(int(at), latest.get(int(item), 0))
            kept = sorted(latest.items(), key=lambda pair: (-pair[1], pair[0]))[:limit]
            latest = dict(kept)
        ordered = sorted(latest.items(), key=lambda pair: (-pair[1], pair[0]))
        items = [item for item, _ in ordered]
        touched = [at for _, at in ordered]
        state.update((items, touched))
        expiry = touched[0] // 1000 + ttl_ms
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "user_id": key[0],
                "item_id": items,
                "touched_us": touched,
                "position": range(1, len(items) + 1),
            }
        )

    timed = events.withWatermark("created_at", LATENESS).select(
        "user_id", "item_id", "created_at", F.unix_micros("created_at").alias("touched_us")
    )
    return timed.groupBy("user_id").applyInPandasWithState(
        update, RECENT_OUTPUT, RECENT_STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
