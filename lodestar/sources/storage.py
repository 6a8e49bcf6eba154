"""Shared-folder handling: where results that outlive a job are written."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Paths of the stages that this process has written and not removed.
_STAGES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for local runs."""
    configured = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lodestar-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    Lost executors then re-read files instead of replaying the plan. A Parquet
    table is computed once, where ``checkpoint()`` computes an uncached plan
    twice, and its columns are pruned by later reads.
    """
    path = new_path(df.sparkSession, "stage")
    _STAGES.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored stage by the file system that holds it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """A scope whose stages are deleted at its end; write what must outlive it inside."""
    before = len(_STAGES)
    try:
        yield
    finally:
        while len(_STAGES) > before:
            remove(spark, _STAGES.pop())


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestar-"), "lodestar")
    # The driver serves this small archive to the executors.
    sc.addPyFile(shutil.make_archive(archive, "zip", root, "lodestar"))
    sc._lodestar_shipped = True
