"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VIRTUAL points on a 64-bit ring; a key belongs to the arc that
ends at the next point clockwise. No shard takes more than its capacity; keys
that find a shard full walk on clockwise to the next shard with room.

The walk is the same for all keys of an arc, so only the number of keys per arc
(shards x VIRTUAL rows, whatever the data) is needed to decide it: an arc is
cut into rank intervals, each of which goes to one shard. Rows then find their
interval by their rank within the arc.

Shards accept keys of their own arcs first, then overflow in ring order. With
``epsilon`` 0 the capacities are the even split itself (row counts at most one
apart); with a larger one fewer keys move and shards may differ by that share.

* A null key is a key like any other. Rows with equal keys are ranked by the
  other columns given, so that repeated rows take neighbouring slots.
* Fewer rows than shards leave shards empty. Nothing is dropped.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.storage import ship_package

#: Ring points per shard.
VIRTUAL = 128


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, list[int]]:
    """Sorted ring positions (signed 64 bit) and the shard of each.

    A shard's points depend on its number alone, so that one more shard only
    adds points.
    """
    points = []
    for shard in range(shards):
        for k in range(virtual):
            digest = hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big", signed=True), shard))
    points.sort()
    return np.array([p for p, _ in points], dtype=np.int64), [s for _, s in points]


def capacities(n: int, shards: int, epsilon: float) -> list[int]:
    if epsilon == 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    most = -int(-(n * (1 + epsilon)) // shards)
    return [max(most, -(-n // shards))] * shards


def walk(
    counts: Sequence[int], owners: Sequence[int], room: Sequence[int]
) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals ``(arc, first, end, shard, first slot)`` that place every key.

    ``counts[a]`` keys lie in the arc before point ``a``; ``owners[a]`` is that
    point's shard. Each interval empties an arc or fills a shard, so there are
    at most arcs + shards of them.
    """
    used = [0] * len(room)
    placed: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int]] = []

    def put(arc: int, first: int, shard: int) -> int:
        take = min(counts[arc] - first, room[shard] - used[shard])
        if take > 0:
            placed.append((arc, first, first + take, shard, used[shard]))
            used[shard] += take
        return first + max(take, 0)

    for arc, n in enumerate(counts):
        first = put(arc, 0, owners[arc]) if n else 0
        if first < n:
            left.append((arc, first))
    free = [a for a, s in enumerate(owners) if used[s] < room[s]]
    for arc, first in left:
        while first < counts[arc]:
            # The next point clockwise whose shard still has room.
            at = bisect.bisect_right(free, arc) % len(free)
            shard = owners[free[at]]
            first = put(arc, first, shard)
            if used[shard] >= room[shard]:
                free = [a for a in free if owners[a] != shard]
    return placed


def assign_shards(
    df: DataFrame,
    key: str,
    shards: int,
    epsilon: float = 0.0,
    virtual: int = VIRTUAL,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 within the shard), replacing columns of these names.

    Only the columns of ``df`` are shuffled, once, by arc; pass narrow rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    positions, owners = ring(shards, virtual)

    @F.pandas_udf("int")
    def arc_of(value: pd.Series) -> pd.Series:
        found = np.searchsorted(positions, value.to_numpy(np.int64), side="left")
        return pd.Series((found % len(positions)).astype(np.int32))

    # The caller's columns travel as one, so that none can clash with those made here.
    ties = [c.alias(f"tie_{i}") for i, c in enumerate(tie_break)]
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), *ties)
    hashed = rows.withColumn("at", F.xxhash64(F.lit("key"), "key")).withColumn("arc", arc_of("at"))
    seen = {row["arc"]: row["count"] for row in hashed.groupBy("arc").count().collect()}  # a row per arc
    counts = [seen.get(a, 0) for a in range(len(owners))]
    room = capacities(sum(counts), shards, epsilon)
    # Bounded by shards x virtual + shards rows, whatever the data.
    intervals = spark.createDataFrame(
        walk(counts, owners, room) or [(-1, 0, 0, 0, 0)],
        "to int, first bigint, end bigint, shard int, from_slot bigint",
    )
    order = Window.partitionBy("arc").orderBy("at", "key", *[f"tie_{i}" for i in range(len(ties))])
    ranked = hashed.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    hit = (F.col("arc") == F.col("to")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    return ranked.join(F.broadcast(intervals), hit).select(
        "row.*", "shard", (F.col("from_slot") + F.col("rank") - F.col("first")).alias("slot")
    )
