"""Joins of many rows with a table of one row per key, without a busy key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt.
PARTS = 16
#: Bytes of a table that is sent whole to the tasks instead.
LOOKUP_BYTES = 64 << 20
#: Rows of one key that a task may meet before they are dealt.
BUSY = 1_000_000


def spread_join(
    many: DataFrame, one: DataFrame, on: Sequence[str], deal: Column, how: str = "inner", parts: int = PARTS
) -> DataFrame:
    """Join rows with a table of one narrow row per key; a key's rows meet it in ``parts`` tasks.

    ``deal`` is an expression over ``many`` that tells rows of one key apart.
    """
    left = many.withColumn("_part", F.pmod(F.xxhash64(deal), F.lit(parts)).cast("int"))
    right = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*on, "_part"], how).drop("_part")


def counted_join(
    many: DataFrame, one: DataFrame, on: Sequence[str], deal: Column, rows: str, how: str = "left", busy: int = BUSY
) -> DataFrame:
    """Join with a stored table of one row per key whose column ``rows`` counts the rows of ``many`` with that key.

    Only keys of more than ``busy`` rows, or of a thousandth of all if that is more, are copied, once
    for every so many rows; all others meet in one place. The busy keys are sent to the tasks: there
    are at most a thousand, by arithmetic. ``rows`` is not in the result.
    """
    total = one.agg(F.sum(rows)).scalar()
    most = F.greatest(F.lit(busy), F.ceil(F.coalesce(total, F.lit(0)) / 1000))
    sized = one.withColumn("_parts", F.greatest(F.ceil(F.col(rows) / most), F.lit(1)).cast("int")).drop(rows)
    hot = sized.where(F.col("_parts") > 1).select(*on, "_parts")
    part = F.pmod(F.xxhash64(deal), F.coalesce("_parts", F.lit(1))).cast("int")
    left = many.join(F.broadcast(hot), list(on), "left").withColumn("_part", part).drop("_parts")
    right = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    deal: Column,
    how: str = "inner",
    row_bytes: int = 256,
    most_bytes: int = LOOKUP_BYTES,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join with a stored or cheap table of one row per key, sent to the tasks if its counted rows allow it.

    Rows of ``many`` then stay where they are. Counting stops at the bound; beyond
    it the rows of a key are spread (``spread_join``). ``row_bytes`` is what a row
    of ``one`` takes at most; ``counted`` is a cheaper frame with no fewer rows.
    """
    most = max(1, most_bytes // row_bytes)
    if (one if counted is None else counted).limit(most + 1).count() <= most:
        return many.join(F.broadcast(one), list(on), how)
    return spread_join(many, one, on, deal, how)
