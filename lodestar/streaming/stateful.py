"""Operators whose state decides about single rows: limits, expiring values, repeats, late rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar import constants as C
from lodestar.operators import ingest
from lodestar.streaming.ledger import Ledger, event_time_note

LATENESS = "1 hour"

DECISIONS = "event_id bigint, api_key string, window_index bigint, created_us bigint, allowed boolean"


def rate_limit_decisions(
    requests: DataFrame,
    limit: int = C.RATE_LIMIT,
    window_seconds: int = C.RATE_WINDOW_SECONDS,
    delay: str = LATENESS,
) -> DataFrame:
    """Every request once, with whether it is among the first ``limit`` of its (key, fixed window) by event time.

    The state of a window is its first ``limit`` requests so far, however many
    come. A request behind ``limit`` others is refused at once, and so is one that
    an earlier request displaces: nothing can let it in again. What the state holds
    when the watermark passes the window's end was allowed; it is emitted then and
    the state is dropped. Requests later than the watermark are dropped. The rows of
    closed windows are those of the batch form, in whatever order requests arrive.
    """
    width = window_seconds * 1_000_000

    def rows(key: tuple[Any, ...], ids: list, times: list, allowed: bool) -> pd.DataFrame:
        return pd.DataFrame(
            {"event_id": ids, "api_key": key[0], "window_index": key[1], "created_us": times, "allowed": allowed}
        )

    def decide(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ids, times = state.get
            state.remove()
            yield rows(key, ids, times, True)
            return
        held = pd.DataFrame({"event_id": [], "created_us": []}, dtype="int64")
        if state.exists:
            ids, times = state.get
            held = pd.DataFrame({"event_id": ids, "created_us": times}, dtype="int64")
        for frame in frames:
            held = pd.concat([held, frame[["event_id", "created_us"]]]).sort_values(["created_us", "event_id"])
            refused, held = held.iloc[limit:], held.iloc[:limit]
            if len(refused):
                yield rows(key, refused["event_id"].tolist(), refused["created_us"].tolist(), False)
        state.update((held["event_id"].tolist(), held["created_us"].tolist()))
        end_ms = (int(key[1]) + 1) * width // 1000
        state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))

    timed = requests.withWatermark("created_at", delay).select(
        "event_id",
        "api_key",
        ingest.window_index(F.col("created_at"), window_seconds).alias("window_index"),
        F.unix_micros("created_at").alias("created_us"),
        "created_at",
    )
    return timed.groupBy("api_key", "window_index").applyInPandasWithState(
        decide,
        DECISIONS,
        "ids array<bigint>, times array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


#: Groups that keys are dealt over. A restarted query finds its state by group, so their number is fixed.
GROUPS = 512


def _group(key: str) -> Column:
    """The group of a key; null has one of its own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS))).cast("int").alias("group")


def expiring_values(
    log: DataFrame, key: str, value: str, ttl_seconds: int, delay: str = LATENESS
) -> DataFrame:
    """Update stream of the newest ``value`` per ``key``; it goes ``ttl_seconds`` after it was written.

    Nothing deletes a value: every value has a timeout of its own at the time it was
    written plus the TTL. When the watermark, the stream's clock, is past it, the
    key gets a row with null ``value`` and ``written_us``, which replaces the value
    for readers of the newest version. Of values of one moment the largest counts.
    Keys share the state of their group, so a call of Python serves many of them.
    """
    ttl_us = ttl_seconds * 1_000_000
    kind = log.schema[value].dataType.simpleString()
    key_kind = log.schema[key].dataType.simpleString()

    def keep(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {own: (at, found) for own, found, at in zip(*state.get)} if state.exists else {}
        told: dict[Any, tuple] = {}
        for frame in () if state.hasTimedOut else frames:
            last = frame.sort_values(["written_us", value]).drop_duplicates(key, keep="last")
            keys = [None] * len(last) if group[0] < 0 else last[key].tolist()
            for own, found, at in zip(keys, last[value].tolist(), last["written_us"].tolist()):
                told[own] = held[own] = max(held[own], (at, found)) if own in held else (at, found)
        # Some had expired before they came.
        for own in [own for own, (at, _) in held.items() if (at + ttl_us) // 1000 < mark]:
            del held[own]
            told[own] = None, None
        if held:
            times, values = zip(*held.values())
            state.update((list(held), list(values), list(times)))
            state.setTimeoutTimestamp(max((min(times) + ttl_us) // 1000, mark) + 1)
        elif state.exists:
            state.remove()
        if told:
            columns = {key: list(told), value: [found for _, found in told.values()]}
            made = pd.DataFrame({name: pd.Series(rows, dtype=object) for name, rows in columns.items()})
            yield made.assign(written_us=pd.array([at for at, _ in told.values()], dtype="Int64"))

    timed = log.withWatermark("created_at", delay).select(
        _group(key), key, value, "created_at", F.unix_micros("created_at").alias("written_us")
    )
    return timed.where(F.col(value).isNotNull()).groupBy("group").applyInPandasWithState(
        keep,
        f"{key} {key_kind}, {value} {kind}, written_us bigint",
        f"keys array<{key_kind}>, found array<{kind}>, times array<bigint>",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


DELIVERIES = "event_id bigint, created_us bigint, repeated boolean"


def deliveries(events: DataFrame, ttl_seconds: int = C.DEDUPE_TTL_SECONDS, delay: str = LATENESS) -> DataFrame:
    """Every delivery with whether it repeats one that was accepted less than the TTL away.

    ``dropDuplicatesWithinWatermark`` only discards repeats; here accepted and
    repeated deliveries are both emitted. The state of an id is the time of its
    last accepted delivery and goes a TTL after it. Deliveries of a batch pass in
    order of time; simultaneous copies are one accepted delivery and repeats.
    Ids share the state of their group, so a call of Python serves many of them.
    """
    ttl_us = ttl_seconds * 1_000_000

    def judge(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        lasts = dict(zip(*state.get)) if state.exists else {}
        # The distinct times of an id in a batch are what has to be put in order.
        counts = None
        for frame in () if state.hasTimedOut else frames:
            if group[0] < 0:
                frame = frame.assign(event_id=0)
            more = frame.groupby(["event_id", "created_us"]).size()
            counts = more if counts is None else pd.concat([counts, more]).groupby(level=[0, 1]).sum()
        if counts is not None and len(counts):
            counts = counts.sort_index()
            ids, times = (counts.index.get_level_values(level).to_numpy(np.int64) for level in (0, 1))
            fresh = np.zeros(len(ids), dtype=bool)
            for i, (own, at) in enumerate(zip(ids.tolist(), times.tolist())):
                last = lasts.get(own)
                if last is None or at - last >= ttl_us:
                    lasts[own] = at
                    fresh[i] = True
            sizes = counts.to_numpy()
            repeated = np.ones(sizes.sum(), dtype=bool)
            repeated[np.cumsum(sizes) - sizes] = ~fresh
            made = pd.DataFrame({"event_id": np.repeat(ids, sizes), "created_us": np.repeat(times, sizes), "repeated": repeated})
            yield made.assign(event_id=None) if group[0] < 0 else made
        # Rows that could meet an older time are later than the watermark.
        held = {own: last for own, last in lasts.items() if (last + ttl_us) // 1000 + 1 >= mark}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max((min(held.values()) + ttl_us) // 1000, mark) + 1)
        elif state.exists:
            state.remove()

    timed = events.withWatermark("created_at", delay).select(
        _group("event_id"), "event_id", "created_at", F.unix_micros("created_at").alias("created_us")
    )
    return timed.groupBy("group").applyInPandasWithState(
        judge, DELIVERIES, "ids array<bigint>, lasts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


SLOT_ERRORS = "slot bigint, reason string, errors bigint"


def count_errors(ledger: Ledger, events: DataFrame, slot_seconds: int = 300) -> DataFrame:
    """Refused deliveries per reason and slot, repeats included, with rate and alert.

    Rows that fail a check are counted as they come; valid ones pass the repeat
    state first. A batch stores one row per (slot, reason); the counts add up.
    """
    marked = events.withColumn("reason", ingest.rejection_reason())
    slot = F.floor(F.col("created_us") / F.lit(slot_seconds * 1_000_000)).cast("bigint").alias("slot")
    refused = marked.where(F.col("reason").isNotNull()).select(F.unix_micros("created_at").alias("created_us"), "reason")
    repeats = deliveries(marked.where(F.col("reason").isNull())).where("repeated")
    both = refused.unionByName(repeats.select("created_us", F.lit("duplicate").alias("reason"))).select(slot, "reason")
    ledger.run(
        both, lambda batch, _, __: {"rows": batch.groupBy("slot", "reason").agg(F.count(F.lit(1)).alias("errors"))}
    )
    rate = F.col("errors") / F.lit(float(slot_seconds))
    counted = ledger.read(SLOT_ERRORS).groupBy("slot", "reason").agg(F.sum("errors").alias("errors"))
    return counted.withColumn("rate", rate).withColumn("alert", rate > C.ERROR_RATE_ALERT)


def split_late(ledger: Ledger, events: DataFrame, delay_seconds: int = 3600) -> None:
    """Store on-time and late rows of every batch apart.

    A batch's watermark is the newest event time of the batches before it less the
    delay; the ledger holds that time, so a repeated batch and a restarted query
    judge alike. A row before the watermark is late: a stateful query would have
    dropped it without a trace. Parts are ``on_time`` and ``late``; late rows carry
    ``behind_us``, how far behind the watermark they were.
    """

    def parts(batch: DataFrame, own: Ledger, batch_id: int) -> dict[str, DataFrame]:
        newest = own.info_before(batch_id).get("newest_us")
        behind = F.lit(None if newest is None else newest - delay_seconds * 1_000_000).cast("bigint")
        behind = behind - F.unix_micros("created_at")
        late = F.coalesce(behind > 0, F.lit(False))
        return {"on_time": batch.where(~late), "late": batch.where(late).withColumn("behind_us", behind)}

    newest = event_time_note("created_at")

    def note(batch: DataFrame) -> dict:
        before = ledger.entries()
        times = [newest(batch)["newest_us"], before[-1]["info"].get("newest_us") if before else None]
        return {"newest_us": max((t for t in times if t is not None), default=None)}

    ledger.run(events, parts, note)
