"""Event log and training frame: partitioned Parquet in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read Parquet with a fixed schema."""
    return spark.read.schema(schema).parquet(path)


def scan_training_frame(spark: SparkSession, path: str) -> DataFrame:
    from lodestar.schemas import TRAINING_FRAME

    return scan(spark, path, TRAINING_FRAME)


def write_training_snapshot(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Write one folder per day."""
    dated = df.withColumn("dt", F.date_format(ts, "yyyy-MM-dd"))
    rebalanced(dated, "dt").write.partitionBy("dt").parquet(path)


def rebalanced(df: DataFrame, folder: str) -> DataFrame:
    """Rows of a folder together, for few files; adaptive execution splits a busy one."""
    return df.hint("rebalance", folder)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema.add("dt", T.StringType())).parquet(path)


def with_month(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.withColumn("event_month", F.date_format(ts, "yyyy-MM"))


def write_event_log(df: DataFrame, path: str) -> None:
    """Append to the month-partitioned log."""
    logged = rebalanced(with_month(df), "event_month")
    logged.write.mode("append").partitionBy("event_month").parquet(path)


def month_range(df: DataFrame, since: Column, until: Column, ts: str = "created_at") -> DataFrame:
    """Half-open time range; adds the month predicate that prunes folders."""
    months = F.col("event_month").between(
        F.date_format(since, "yyyy-MM"), F.date_format(until, "yyyy-MM")
    )
    return df.filter(months & (F.col(ts) >= since) & (F.col(ts) < until))


def append_new_events(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Append rows whose event_id the log does not hold yet (safe to repeat).

    A repeat may lie in the month before or after, so the months that the batch
    touches and their neighbours are read from the log, and only these folders.
    """
    fresh = with_month(batch).dropDuplicates(["event_id"])
    if log_exists(spark, path):
        fresh = fresh.join(logged_near(spark, batch, path), "event_id", "left_anti")
    rebalanced(fresh, "event_month").write.mode("append").partitionBy("event_month").parquet(path)


def logged_near(spark: SparkSession, batch: DataFrame, path: str) -> DataFrame:
    """Ids that the log holds in the batch's months and their neighbours."""
    log = spark.read.schema(with_month(batch).schema).parquet(path)
    return log.filter(F.col("event_month").isin(touched_months(batch))).select("event_id")


def touched_months(batch: DataFrame, ts: str = "created_at") -> list[str]:
    """Months of the batch with their neighbours: a handful of names on the driver."""
    around = F.array(*[F.date_format(F.add_months(ts, n), "yyyy-MM") for n in (-1, 0, 1)])
    return [row[0] for row in batch.select(F.explode(around)).distinct().collect()]


def log_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path) and len(fs.listStatus(jvm_path)) > 0
