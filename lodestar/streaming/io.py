"""Streaming sources, sinks and run helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import schemas
from lodestar.operators import ingest
from lodestar.sources.bindings import bind_interactions
from lodestar.sources.storage import new_path

Handler = Callable[[DataFrame, int], None]


def file_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int = 64
) -> DataFrame:
    """Stream of the Parquet files of one name pattern in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Interactions as a stream, with an event time that accepts watermarks."""
    raw = file_stream(spark, folder, name, schemas.RAW_EVENTS)
    return bind_interactions(raw).withColumn("created_at", F.col("created_at").cast("timestamp"))


def topic_stream(spark: SparkSession, servers: str, topics: list[str], per_trigger: int) -> DataFrame:
    """Messages of broker topics from the earliest offset (needs the Kafka connector)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
        .select(F.col("key").cast("string"), F.col("value").cast("string"), "topic")
    )


def decoded(messages: DataFrame) -> DataFrame:
    return ingest.decode_json(messages, schemas.EVENT)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end of the available input; rows appended exactly once."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", path + "-checkpoint")
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, name: str, handler: Handler, mode: str = "append") -> None:
    """Run ``handler(batch, batch_id)`` over the available input."""
    path = new_path(stream.sparkSession, name + "-checkpoint")
    query = (
        stream.writeStream.foreachBatch(handler)
        .option("checkpointLocation", path)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_writer(path: str) -> Handler:
    """Each batch to its own folder, overwritten when the batch is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_newest(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode query whose output replaces all rows of a key; the rows of each key's last batch."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    run_batches(stream, name, batch_writer(path), "update")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    versions = spark.read.schema(schema).parquet(path)
    newest = versions.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return versions.join(newest, [*keys, "batch"], "left_semi").drop("batch")


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode aggregation; the result is the last version of each key."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    run_batches(stream, name, batch_writer(path), "update")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    versions = spark.read.schema(schema).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    latest = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, *[F.col("v")[c].alias(c) for c in values])
