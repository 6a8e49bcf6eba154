"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("dwell_ms", T.IntegerType()),
        T.StructField("device", T.StringType()),
        T.StructField("client_timestamp", T.TimestampNTZType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

TRAINING_FRAME = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("device_id", T.IntegerType()),
        T.StructField("time_of_day", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("recent_item_sequence", T.ArrayType(T.LongType())),
        T.StructField("content_embedding", T.ArrayType(T.FloatType())),
        T.StructField("freshness_score", T.DoubleType()),
        T.StructField("historical_ctr", T.DoubleType()),
        T.StructField("user_item_dot_product", T.DoubleType()),
    ]
)

USER_METADATA = T.StructType(
    [
        T.StructField("device", T.StringType()),
        T.StructField("onboarding_categories", T.ArrayType(T.StringType())),
    ]
)
