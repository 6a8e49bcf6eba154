"""Validation, routing, de-duplication and rate limiting of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions.joins import spread_join


def validate_event_type(events: DataFrame) -> DataFrame:
    """Rows with a known event type and both ids."""
    return events.filter(
        E.is_known_event(F.col("event_type"))
        & F.col("user_id").isNotNull()
        & F.col("item_id").isNotNull()
    )


def clock_status(client: Column, now: Column) -> Column:
    """'ok', 'future' (over 300 s ahead) or 'expired' (over 7 days old)."""
    ahead = E.micros(client) - E.micros(now)
    return (
        F.when(client.isNull(), "ok")
        .when(ahead > C.MAX_CLOCK_SKEW_SECONDS * 1_000_000, "future")
        .when(-ahead > C.MAX_EVENT_AGE_SECONDS * 1_000_000, "expired")
        .otherwise("ok")
    )


def timestamp_gate(events: DataFrame, now: str = "created_at") -> DataFrame:
    """Rows whose client clock is plausible at receive time."""
    return events.filter(clock_status(F.col("client_timestamp"), F.col(now)) == "ok")


def rejection_reason(now: str = "created_at") -> Column:
    """Why a decoded row is refused; null when it is accepted."""
    status = clock_status(F.col("client_timestamp"), F.col(now))
    return (
        F.when(F.col("event_id").isNull(), "malformed")
        .when(F.col("user_id").isNull() | F.col("item_id").isNull(), "missing_id")
        .when(~E.is_known_event(F.col("event_type")) | F.col("event_type").isNull(), "unknown_type")
        .when(status != "ok", status)
    )


def dead_letter_split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reason)."""
    marked = events.withColumn("reason", rejection_reason())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(
        F.col("reason").isNotNull()
    )


# Keeps microseconds; the JSON writer's default stops at milliseconds.
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def encode_json(events: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """Message form: key and JSON value, as a topic carries them."""
    return events.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*schema.fieldNames()), JSON_OPTIONS).alias("value"),
    )


def decode_json(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Typed rows; a message that does not parse becomes a row of nulls."""
    return messages.select(F.from_json(value, schema, JSON_OPTIONS).alias("event")).select("event.*")


def fan_out(events: DataFrame) -> DataFrame:
    """Two messages per event: one keyed by user, one keyed by item."""
    routes = F.array(
        F.struct(F.lit("user-events").alias("topic"), F.col("user_id").alias("key")),
        F.struct(F.lit("item-events").alias("topic"), F.col("item_id").alias("key")),
    )
    return events.withColumn("route", F.explode(routes)).select("route.topic", "route.key", *events.columns)


def dedupe_events(events: DataFrame, ttl_seconds: int = C.DEDUPE_TTL_SECONDS) -> DataFrame:
    """(event_id, created_at) of accepted deliveries.

    A delivery is accepted when at least ``ttl_seconds`` have passed since the
    last accepted one of the same id. Simultaneous copies count as one.

    The events are read once. Copies of one moment combine before the shuffle;
    each id's distinct times then pass in order, with the last accepted one as
    the only state, so an id may have any number of deliveries. Rows without an
    id or a time are left out.
    """
    ttl = ttl_seconds * 1_000_000
    times = events.select("event_id", E.micros(F.col("created_at")).alias("us")).dropna().distinct()
    ordered = times.repartition("event_id").sortWithinPartitions("event_id", "us")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, 0
        for batch in batches:
            ids = batch.column("event_id").to_numpy(zero_copy_only=False)
            us = batch.column("us").to_numpy(zero_copy_only=False)
            taken: list[int] = []
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else ids
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                at = start
                if ids[start] != current:
                    current, last = ids[start], us[start]
                    taken.append(start)
                while True:
                    # The next delivery that is due; those before it are repeats.
                    at = at + int(np.searchsorted(us[at:end], last + ttl))
                    if at >= end:
                        break
                    taken.append(at)
                    last = us[at]
            yield batch.take(pa.array(taken, pa.int64()))

    accepted = ordered.mapInArrow(fold, ordered.schema)
    return accepted.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("created_at"))


def window_index(ts: Column, seconds: int) -> Column:
    return F.floor(E.micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def rate_limit(
    events: DataFrame,
    limit: int = C.RATE_LIMIT,
    window_seconds: int = C.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Every request with its fixed window and whether it was allowed.

    Only the first ``limit`` requests per (key, window) are ranked - the rank
    filter is applied before the shuffle - and the last of them is the cut
    that the other requests are compared with, dealt over several tasks.
    """
    keyed = events.withColumn("window_index", window_index(F.col("created_at"), window_seconds))
    order = Window.partitionBy("api_key", "window_index").orderBy("created_at", "event_id")
    first = keyed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    cut = first.groupBy("api_key", "window_index").agg(
        F.max(F.struct("created_at", "event_id")).alias("cut")
    )
    arrival = F.struct("created_at", "event_id")
    return spread_join(keyed, cut, ["api_key", "window_index"], F.col("event_id")).select(
        *events.columns, "window_index", (arrival <= F.col("cut")).alias("allowed")
    )


def rate_limit_rejections(limited: DataFrame, alert: float = C.REJECTION_RATE_ALERT) -> DataFrame:
    """Rejected requests per 5 minutes and whether their rate needs an alert."""
    slot = window_index(F.col("created_at"), 300)
    return (
        limited.groupBy(slot.alias("slot"))
        .agg(F.count_if(~F.col("allowed")).alias("rejected"), F.count("*").alias("requests"))
        .withColumn("alert", F.col("rejected") / 300.0 > alert)
    )


def ingestion_errors(events: DataFrame, accepted: DataFrame) -> DataFrame:
    """Refused deliveries per reason and 5-minute slot, with the alert flag.

    Clock rejections come first (they do not use up the id); repeats of an
    accepted id are duplicates.
    """
    marked = events.withColumn("reason", rejection_reason())
    slot = window_index(F.col("created_at"), 300).alias("slot")
    refused = (
        marked.filter(F.col("reason").isNotNull())
        .groupBy(slot)
        .agg(F.count("*").alias("errors"))
        .select("slot", F.lit("invalid").alias("reason"), "errors")
    )
    valid = marked.filter(F.col("reason").isNull()).groupBy(slot).agg(F.count("*").alias("n"))
    kept = accepted.groupBy(slot).agg(F.count("*").alias("kept"))
    duplicates = valid.join(kept, "slot", "left").select(
        "slot",
        F.lit("duplicate").alias("reason"),
        (F.col("n") - F.coalesce("kept", F.lit(0))).alias("errors"),
    )
    return (
        refused.unionByName(duplicates.filter("errors > 0"))
        .withColumn("rate", F.col("errors") / 300.0)
        .withColumn("alert", F.col("rate") > C.ERROR_RATE_ALERT)
    )


def sessionize(events: DataFrame, keys: list[str], gap_seconds: int = C.SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions by inactivity gap: one row per (keys, session).

    Events less than one gap apart share a session, so all events of a
    gap-wide slot do: slots are aggregated first (map side included), and only
    slot rows reach the window, however busy a key is.
    """
    slots = (
        events.withColumn("_slot", window_index(F.col("created_at"), gap_seconds))
        .groupBy(*keys, "_slot")
        .agg(
            F.min("created_at").alias("_first"),
            F.max("created_at").alias("_last"),
            F.count("*").alias("_n"),
        )
    )
    order = Window.partitionBy(*keys).orderBy("_slot")
    idle = E.micros(F.col("_first")) - E.micros(F.lag("_last").over(order))
    starts = slots.withColumn("_new", F.coalesce(idle >= gap_seconds * 1_000_000, F.lit(True)))
    numbered = starts.withColumn("session_no", F.sum(F.col("_new").cast("bigint")).over(order))
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("_first").alias("session_start"),
        F.max("_last").alias("session_end"),
        F.sum("_n").alias("events"),
    )


def pipeline_lag(events: DataFrame, processed_at: Column) -> DataFrame:
    """Age of the newest event when it is processed, with the alert flag."""
    newest = events.agg(F.max("created_at").alias("newest"))
    lag = F.greatest(E.seconds_between(processed_at, F.col("newest")), F.lit(0.0))
    return newest.select(lag.alias("lag_seconds")).withColumn(
        "alert", F.col("lag_seconds") > C.LAG_ALERT_SECONDS
    )


def consumed_by_type(events: DataFrame, seconds: int = 300) -> DataFrame:
    slot = window_index(F.col("created_at"), seconds).alias("slot")
    return events.groupBy(slot, "event_type").agg(F.count("*").alias("events"))


def feedback_interactions(feedback: DataFrame, interactions: DataFrame) -> DataFrame:
    """Explicit feedback joins the event log as ordinary interactions."""
    return interactions.unionByName(feedback, allowMissingColumns=True)


def feedback_override(
    scores: DataFrame, feedback: DataFrame, now: Column, ttl_seconds: int = C.ITEM_SCORE_TTL_SECONDS
) -> DataFrame:
    """Item scores, forced to -1.0 while a report or hide is the last feedback."""
    live = feedback.filter(
        (F.col("created_at") <= now) & (F.col("created_at") > E.ago(now, ttl_seconds))
    )
    latest = live.groupBy("item_id").agg(
        F.max_by("event_type", F.struct("created_at", "event_id")).alias("last_feedback")
    )
    suppressed = F.col("last_feedback").isin(C.SUPPRESSING_EVENTS)
    return scores.join(latest, "item_id", "left").select(
        "item_id",
        F.when(suppressed, -1.0).otherwise(F.col("score")).alias("score"),
        F.coalesce(suppressed, F.lit(False)).alias("suppressed"),
    )


def accepted_rows(events: DataFrame, accepted: DataFrame) -> DataFrame:
    """Whole rows of accepted deliveries, one per (event_id, created_at)."""
    return events.join(accepted, ["event_id", "created_at"], "left_semi").dropDuplicates(
        ["event_id", "created_at"]
    )
