"""Batches of a stream as committed folders: what a restarted query goes on from.

A named place in the shared folder holds the query's checkpoint, one data folder
per attempt of a batch, and a manifest with one small file per committed batch.
A batch counts once its manifest file exists; the file is written aside and
renamed, so it is there whole or not at all. Folders that no manifest file names
(half-written batches, lost attempts) are never read.

A batch that Spark repeats after a restart finds its manifest file and does
nothing, so every batch has its effect once. ``compact`` folds the committed
batches into one base, so readers don't go over all versions ever written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a batch is turned into before it is stored: (batch, ledger, batch id) -> named parts.
Parts = Callable[[DataFrame, "Ledger", int], dict[str, DataFrame]]


class Ledger:
    """Committed batches below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifest = f"{self.path}/manifest"

    # ---- files -------------------------------------------------------------

    def _file(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self):
        return self._file(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, name: str, entry: dict) -> None:
        """Write a manifest file aside, then rename it."""
        system = self._system()
        aside, final = self._file(f"{self.path}/aside/{uuid.uuid4().hex}"), self._file(f"{self._manifest}/{name}")
        system.mkdirs(final.getParent())
        out = system.create(aside, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not system.rename(aside, final):
            raise OSError(f"batch is committed already: {final}")

    def _list(self, folder: str) -> list[str]:
        system, at = self._system(), self._file(folder)
        return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []

    # ---- entries -----------------------------------------------------------

    def entries(self) -> list[dict]:
        """The newest base, if any, and the batches committed after it, in order."""
        names = self._list(self._manifest)
        if not names:
            return []
        lines = self.spark.read.text(self._manifest, wholetext=True).collect()  # one short row per batch
        found = sorted((json.loads(r["value"]) for r in lines), key=lambda e: (e["batch"], e["base"]))
        start = max((i for i, e in enumerate(found) if e["base"]), default=0)
        first = found[start]["batch"] if found[start]["base"] else None
        return [found[start]] + [e for e in found[start + 1 :] if first is None or e["batch"] > first]

    def last_batch(self) -> int:
        return max((e["batch"] for e in self.entries()), default=-1)

    def info_before(self, batch_id: int) -> dict:
        """What the last batch before this one noted."""
        return next((e["info"] for e in reversed(self.entries()) if e["batch"] < batch_id), {})

    def store(self, batch_id: int, parts: dict[str, DataFrame], info: dict | None = None) -> None:
        """Write the parts of a batch and commit them together."""
        folders = {}
        for name, rows in parts.items():
            folders[name] = f"{self.path}/data/{name}-{batch_id}-{uuid.uuid4().hex}"
            rows.write.parquet(folders[name])
        self._put(f"{batch_id:020d}", {"batch": batch_id, "base": False, "parts": folders, "info": info or {}})

    # ---- running and reading -----------------------------------------------

    def run(
        self,
        stream: DataFrame,
        parts: Parts | None = None,
        info: Callable[[DataFrame], dict] | None = None,
        mode: str = "append",
    ) -> None:
        """Run ``stream`` from where the ledger's last run stopped to the end of the input."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            if batch_id <= self.last_batch():
                return
            batch.persist()  # read by every part and the note
            try:
                made = parts(batch, self, batch_id) if parts else {"rows": batch}
                self.store(batch_id, made, info(batch) if info else None)
            finally:
                batch.unpersist()

        query = (
            stream.writeStream.foreachBatch(handle)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def read(self, schema: T.StructType | str, part: str = "rows") -> DataFrame:
        """Rows of all committed batches with their ``batch``; a base has that of the last batch it folds."""
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        out = None
        for entry in self.entries():
            if part in entry["parts"]:
                rows = self.spark.read.schema(schema).parquet(entry["parts"][part])
                rows = rows.withColumn("batch", F.lit(entry["batch"]).cast("bigint"))
                out = rows if out is None else out.unionAll(rows)
        if out is None:
            out = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
        return out

    def newest(self, schema: T.StructType | str, keys: list[str], part: str = "rows") -> DataFrame:
        """The rows of each key's last batch."""
        versions = self.read(schema, part)
        last = versions.groupBy(*keys).agg(F.max("batch").alias("batch"))
        return versions.join(last, [*keys, "batch"], "left_semi").drop("batch")

    def compact(self, fold: Callable[[DataFrame], DataFrame], schema: T.StructType | str, part: str = "rows") -> None:
        """Replace the committed batches of a one-part ledger by one base of ``fold(rows)``; remove their folders."""
        old = self.entries()
        if len(old) < 2:
            return
        folder = f"{self.path}/data/base-{old[-1]['batch']}-{uuid.uuid4().hex}"
        fold(self.read(schema, part)).write.parquet(folder)
        entry = {"batch": old[-1]["batch"], "base": True, "parts": {part: folder}, "info": old[-1]["info"]}
        self._put(f"{entry['batch']:020d}-base-{uuid.uuid4().hex}", entry)
        # From here on readers take the base; what it folds is no longer named.
        named = {folder.rsplit("/", 1)[-1]}
        system = self._system()
        for name in self._list(f"{self.path}/data"):
            if name not in named:
                system.delete(self._file(f"{self.path}/data/{name}"), True)


def event_time_note(column: str) -> Callable[[DataFrame], dict]:
    """A batch note: the newest event time in microseconds (null for a batch without rows)."""

    def note(batch: DataFrame) -> dict:
        return {"newest_us": batch.agg(F.unix_micros(F.max(column))).first()[0]}

    return note
