"""Importance resampling of documents towards a target distribution.

Features are all runs of 1 to LONGEST consecutive words; a feature falls into
the bucket of its CRC-32. Words come from a dictionary automaton: the distinct
words of a block of texts, each bounded by a delimiter on both sides, form an
Aho-Corasick automaton whose payloads are a word's CRC-32 and length. One scan
of a text emits the payloads of its words in order. Payloads of neighbours are
composed (the CRC of joined words follows from their CRCs and the length of the
second), which gives the buckets of longer runs without touching text again.

Buckets of every document are stored, two bytes a feature. Their counts over
all documents and over the target give each bucket a gain: the logarithm of its
smoothed share in the target over that in the documents. A document's weight is
the mean gain of its features. Gumbel noise, a hash of seed and doc_id, is added
to it, and the highest scores are drawn: without replacement, in proportion to
the exponential of the weight.

Counts are one row per bucket and task before they are shuffled, so no feature
is hot. Only BUCKETS gains reach the driver and the tasks. Ranks come from value
slices of narrow rows; no task ranks them all.

* Words are runs of ASCII letters (A-Z lower-cased), digits and characters
  beyond ASCII. A null or empty text has no words: weight 0, never drawn.
* Ties of score are drawn by smaller doc_id; a null doc_id is hashed as an empty
  name and comes last. Rows that repeat a doc_id have the same noise.
* Without target words all gains follow from the smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.numbering import quantile_slice, sliced_row_number
from lodestar.sources.storage import cut_lineage, ship_package

LONGEST, BUCKETS, SEED = 1, 10_000, "2024"
#: Fewest words of a document that can be drawn, and the share drawn in hundredths.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of text under one automaton.
BLOCK = 4_000_000

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_CRC = 0xFFFFFFFF


def word_automaton(words: set[bytes]) -> ahocorasick.Automaton:
    """Automaton of delimited words; payloads are length and CRC-32 in one number."""
    found = ahocorasick.Automaton()
    for word in words:
        # Bytes are scanned as characters of one byte.
        found.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
    if words:
        found.make_automaton()
    return found


@lru_cache(maxsize=256)
def _shift(length: int) -> np.ndarray:
    """Four tables that carry a CRC-32 over ``length`` bytes of zero, one per byte of the CRC."""
    tables = np.zeros((4, 256), dtype=np.uint32)
    # Appending zeros is linear in the bits of the CRC, so single bits suffice.
    step = np.array([1 << k for k in range(32)], dtype=np.uint64)
    result = step.copy()
    power = np.array([_zero_byte(int(x)) for x in step], dtype=np.uint64)
    n = length
    while n:
        if n & 1:
            result = _apply(power, result)
        power = _apply(power, power)
        n >>= 1
    for byte in range(4):
        for value in range(256):
            bits = [int(result[8 * byte + k]) for k in range(8) if value >> k & 1]
            tables[byte, value] = np.bitwise_xor.reduce(np.array([0, *bits], dtype=np.uint32))
    return tables


def _zero_byte(crc: int) -> int:
    for _ in range(8):
        crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    return crc


def _apply(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The product of two bit matrices whose columns are numbers."""
    out = np.zeros(len(columns), dtype=np.uint64)
    for k in range(32):
        out ^= np.where(columns >> np.uint64(k) & np.uint64(1) == 1, matrix[k], np.uint64(0))
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from both CRCs and the byte lengths of the second ones."""
    out = second.astype(np.uint32)
    first = first.astype(np.uint32)
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        tables, crc = _shift(int(length)), first[mine]
        moved = tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]
        out[mine] ^= moved
    return out


def run_crcs(payloads: np.ndarray, longest: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to ``longest`` neighbouring words, joined by a space."""
    crc, length = (payloads & _CRC).astype(np.uint32), payloads >> 32
    out = [crc]
    if longest > 1:
        space = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
        spaced = joined_crc(space, crc, length)
        run = crc
        for n in range(2, longest + 1):
            if len(crc) < n:
                break
            # Runs of n words are runs of n - 1 words, a space and one more word.
            run = joined_crc(run[:-1], spaced[n - 1 :], length[n - 1 :] + 1)
            out.append(run)
    return np.concatenate(out)


def features(texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number of words and the buckets of its features."""
    clean = [t.translate(_WORD_BYTES).split() for t in texts]
    scanner = word_automaton(set().union(*clean))
    for words in clean:
        if not words:
            yield 0, np.zeros(0, dtype=np.int64)
            continue
        line = f" {b' '.join(words).decode('latin-1')} "
        payloads = np.fromiter((value for _, value in scanner.iter(line)), np.int64, len(words))
        yield len(words), run_crcs(payloads, longest).astype(np.int64) % buckets


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, key: Column, text: str, longest: int, buckets: int) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``buckets`` (packed numbers) of every row."""
    ship_package(docs.sparkSession)
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BLOCK):
                    size += len(texts[stop])
                    stop += 1
                found = list(features(texts[at:stop], longest, buckets))
                arrays = [
                    batch.column("key").slice(at, stop - at),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([len(b) for _, b in found], pa.int64()),
                    pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_words", "n_features", "buckets"])
                at = stop

    slim = docs.select(key.alias("key"), F.col(text).alias("text"))
    kind_of_key = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind_of_key}, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; a task passes on one row per bucket at most."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for blob in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(blob, dtype=kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = table.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    buckets, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    out = []
    for own, wanted in zip(corpus.tolist(), target.tolist()):
        ratio = float(wanted + 1) * float(s + buckets) / (float(own + 1) * float(t + buckets))
        out.append(math.floor(1000 * math.log(ratio)))
    return np.array(out, dtype=np.int64)


def importance_scores(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words``, ``n_features``, ``weight``, ``score`` of every row."""
    spark = docs.sparkSession
    name = F.struct(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    table = cut_lineage(bucketed(docs, name, text, longest, buckets))
    wanted = bucketed(target, F.lit(0), target_text, longest, buckets)
    shared = spark.sparkContext.broadcast(gains(bucket_counts(table, buckets), bucket_counts(wanted, buckets)))
    kind = _kind(buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            weights = []
            for blob in batch.column("buckets").to_pylist():
                own = np.frombuffer(blob, dtype=kind)
                weights.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            columns = [batch.column(c) for c in ("key", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(weights, pa.int64())], names=["key", "n_words", "n_features", "weight"]
            )

    weighed = table.mapInArrow(
        weigh, "key struct<doc_id: bigint, text_hash: bigint>, n_words bigint, n_features bigint, weight bigint"
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key.doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform))).cast("bigint")
    return weighed.select("key.*", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def resampling_report(
    docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, **options
) -> DataFrame:
    """The scores of every row and ``rank``: its place among the drawn rows, or null."""
    scored = cut_lineage(importance_scores(docs, target, **options))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.agg(F.floor(F.count(F.lit(1)) * percent / 100).cast("bigint")).scalar()
    falling = able.withColumn("falling", -F.col("score"))
    order = [F.col("falling"), F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    ranked = sliced_row_number(quantile_slice(falling, "falling"), [], order, "rank").drop("falling")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(others)


def draw_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``; rows that repeat both doc_id and text are drawn together."""
    report = resampling_report(docs, target, key=key, text=text, **options)
    chosen = report.where(F.col("rank").isNotNull()).select("doc_id", "text_hash").distinct()
    packed = docs.select(F.struct("*").alias("row"))
    own = F.col("row").getField(key).cast("bigint"), F.xxhash64(F.col("row").getField(text))
    same = own[0].eqNullSafe(chosen["doc_id"]) & (own[1] == chosen["text_hash"])
    return packed.join(chosen, same, "left_semi").select("row.*")
