"""Scalar rules about behavioural events and items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar import constants as C

UUID_PATTERN = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session time zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def timestamp_lit(value: str | dt.datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def ago(now: Column, seconds: int) -> Column:
    """Timestamp ``seconds`` before ``now``; folds to a literal, so it is pushed down."""
    return now - F.make_dt_interval(secs=F.lit(float(seconds)))


def signal_weight(event_type: Column) -> Column:
    expr = None
    for name, weight in C.SIGNAL_WEIGHTS.items():
        cond = event_type == name
        expr = F.when(cond, weight) if expr is None else expr.when(cond, weight)
    return expr


def is_known_event(event_type: Column) -> Column:
    return event_type.isin(C.EVENT_TYPES)


def is_negative(event_type: Column) -> Column:
    return event_type.isin(C.NEGATIVE_EVENTS)


def is_impression(event_type: Column) -> Column:
    return event_type.isin(C.IMPRESSION_EVENTS)


def freshness(created_at: Column, now: Column) -> Column:
    age_hours = F.greatest(seconds_between(now, created_at) / 3600.0, F.lit(0.0))
    return F.pow(F.lit(0.5), age_hours / C.FRESHNESS_HALF_LIFE_HOURS)


def composite(fresh: Column, popularity: Column, weight: float = C.FRESHNESS_WEIGHT) -> Column:
    return F.lit(weight) * fresh + F.lit(1.0 - weight) * popularity


def list_index(value: Column, names: list[str]) -> Column:
    """0-based position in a fixed list; null when absent."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0)).cast("int") - 1


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def is_well_formed_uuid(value: Column) -> Column:
    return value.rlike(UUID_PATTERN)
