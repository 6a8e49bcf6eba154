"""Deterministic randomness and bucketing from SHA-256.

``rand()`` changes with partitioning and task retries, so every random choice
in the library is a hash of (seed, keys): stable across runs, executors lost
and repartitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(1 << 52)


def sha_hex(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts joined by ':' (plain strings are literals)."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(":", *cols), 256)


def hash_uniform(seed: str, *keys: Column) -> Column:
    """Uniform double in [0, 1): the first 52 bits of the hash."""
    head = F.substring(sha_hex(seed, *keys), 1, 13)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(_TWO_52)


def hash_index(seed: str, *keys: Column, size: Column) -> Column:
    """Uniform integer in [0, size)."""
    return F.floor(hash_uniform(seed, *keys) * size).cast("bigint")


def hash_mod(text: Column, modulus: int) -> Column:
    """The whole 256-bit digest modulo ``modulus`` (at most 10000).

    Eight 32-bit words are folded by Horner's rule; the loop is unrolled here
    so that it stays inside generated code.
    """
    digest = F.sha2(text, 256)
    step = (1 << 32) % modulus
    acc = F.lit(0).cast("bigint")
    for word in range(8):
        part = F.conv(F.substring(digest, word * 8 + 1, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(step) + part) % F.lit(modulus)
    return acc.cast("int")
