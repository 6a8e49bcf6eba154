"""I-Match document fingerprints over randomised lexicon subsets.

A term is a lower-cased run of characters other than ASCII punctuation and
space. The lexicon holds the terms whose inverse document frequency lies in a
band, here given as shares of the documents (LOWEST to HIGHEST). A fingerprint
is one hash per lexicon subset: the document's distinct terms of that subset,
sorted, hashed.

There are DRAWS families of nested random subsets; the subset of power p keeps
a lexicon term with probability 2^-p. A document is hashed at LEVELS powers, from
the one where one or two of its terms remain in a subset upwards, so that texts
of any length have subsets that a local edit leaves alone. A power has its own
part of the slots (power modulo LEVELS), and a hash depends on its power. A text
without lexicon terms has the hash of all its terms in one more slot.

The lexicon is broadcast. Its size doesn't grow with the corpus: terms in at
least a share f of N documents number at most (mean distinct terms) / f, as
their document counts add up to no more than N x mean.

* A null text is the empty text, whose fingerprint has empty slots only.
* Equal texts have equal fingerprints; repeated rows count once each.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import ship_package

#: Band of document frequency, as shares of all documents.
LOWEST, HIGHEST = 0.002, 0.1
#: Families of nested subsets, slots of a fingerprint, and the largest power.
DRAWS, LEVELS, MOST = 16, 3, 39
SLOTS = LEVELS * DRAWS + 1
EMPTY = 0
#: Distinct terms that a task counts before it passes them on.
COUNTED = 400_000
#: Documents per slice of the id order.
SLICE = 8192
#: Slices at most; beyond, they get longer.
MOST_SLICES = 20_000
#: Terms a worker remembers with their place in the lexicon.
REMEMBERED = 300_000

_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def terms(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_TO_SPACE).split())


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 0)


def kept_powers(hashed: int) -> np.ndarray:
    """For each family the largest power whose subset keeps the term; depends on the term alone."""
    data = hashlib.shake_128(hashed.to_bytes(8, "little")).digest(5 * DRAWS)
    draws = [int.from_bytes(data[i : i + 5], "little") | 1 << MOST for i in range(0, 5 * DRAWS, 5)]
    # Trailing zero bits of uniform draws are geometric.
    return np.array([(d & -d).bit_length() - 1 for d in draws], dtype=np.int8)


class Lexicon(dict):
    """Term -> its number in the lexicon (by order of the hashes), -1 outside; remembers REMEMBERED terms."""

    def __init__(self, hashes: list[int]):
        super().__init__()
        self.hashes = np.array(sorted(hashes), dtype=np.uint64)
        self.powers = np.array([kept_powers(int(h)) for h in self.hashes], dtype=np.int8).reshape(-1, DRAWS)
        self._place = {h: i for i, h in enumerate(self.hashes.tolist())}

    def __reduce__(self):
        return Lexicon, (self.hashes.tolist(),)

    def __missing__(self, term: bytes) -> int:
        number = self._place.get(term_hash(term), -1)
        if len(self) < REMEMBERED:
            self[term] = number
        return number


def slots(text: str, lexicon: Lexicon) -> np.ndarray:
    """SLOTS subset hashes; 0 where no term of the document is in the subset."""
    found = terms(text)
    out = np.zeros(SLOTS, dtype=np.uint32)
    numbers = np.array(list(map(lexicon.__getitem__, found)), dtype=np.int64)
    numbers = np.sort(numbers[numbers >= 0])
    if not len(numbers):
        if found:
            out[-1] = xxhash.xxh32_intdigest(b" ".join(sorted(found))) or 1
        return out
    hashes, powers = lexicon.hashes[numbers], lexicon.powers[numbers]
    lower = len(numbers).bit_length() - 1
    draw, term = np.nonzero(powers.T >= lower)
    height = powers[term, draw]
    for power in range(lower, lower + LEVELS):
        tall = height >= power
        members, data = draw[tall], hashes[term[tall]].tobytes()
        ends = np.cumsum(np.bincount(members, minlength=DRAWS)).tolist()
        part = DRAWS * (power % LEVELS)
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                out[part + k] = xxhash.xxh32_intdigest(data[8 * a : 8 * b], power) or 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal slots among those that either has; 1 for two empty fingerprints."""
    either = (a != EMPTY) | (b != EMPTY)
    return float((a == b)[either].mean()) if either.any() else 1.0


def written(slot: np.ndarray) -> str:
    return slot.astype(">u4").tobytes().hex()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term`` (64-bit hash) and ``df``: documents that hold it. Tasks count before the shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(terms(text or ""))
                if len(counts) > COUNTED:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)

    def flush(counts: Counter[bytes]) -> pa.RecordBatch:
        hashes = np.array([term_hash(t) for t in counts], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "term bigint, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("df"))


def build_lexicon(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST) -> Lexicon:
    """Terms in at least max(2, lowest x N) and at most highest x N documents (2 at least)."""
    n = docs.count()
    least, most = max(2, math.ceil(lowest * n)), max(2, math.floor(highest * n))
    band = document_frequencies(docs).where(F.col("df").between(least, most)).select("term")
    found = [row["term"] & 0xFFFFFFFFFFFFFFFF for row in band.collect()]
    return Lexicon(found)


def in_id_order(docs: DataFrame, per_slice: int = SLICE) -> DataFrame:
    """Rows (doc_id, text) dealt to slices of the id order: ``slice``, ``own``, ``doc_id``, ``text``.

    A slice also holds, with ``own`` false, the first row of the next slice (the
    last one: of the first), so that every own row finds its successor inside.
    Partitions are sorted by slice, own rows first, then id; a null id comes
    first, and equal ids, which lie in one slice, follow a hash of their text.
    Texts are shuffled once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    least = -(1 << 63)
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("key"),
        "text",
    )
    parts = min(MOST_SLICES, max(1, -(-docs.count() // per_slice)))
    points = [i / parts for i in range(1, parts)] or [0.5]
    found = keyed.agg(F.percentile_approx("key", points, max(10_000, 2 * parts))).first()[0]
    edges = np.array(sorted(set(found or [])) if parts > 1 else [], dtype=np.int64)

    @F.pandas_udf("int")
    def slice_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(np.int64), side="right").astype(np.int32))

    sliced = keyed.withColumn("slice", slice_of("key"))
    # One row per slice, MOST_SLICES at most.
    firsts = sorted((r[0], r[1]) for r in sliced.groupBy("slice").agg(F.min("key")).collect())
    targets = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    ends = spark.createDataFrame(targets or [(least, -1)], "_first bigint, _end int")
    own = F.struct("slice", F.lit(True).alias("own"))
    other = F.struct(F.col("_end").alias("slice"), F.lit(False).alias("own"))
    places = F.when(F.col("_end").isNull(), F.array(own)).otherwise(F.array(own, other))
    dealt = sliced.join(F.broadcast(ends), F.col("key") == F.col("_first"), "left").select(
        "doc_id", "key", "text", F.explode(places).alias("at")
    )
    return (
        dealt.select("at.slice", "at.own", "doc_id", "key", "text")
        .repartition("slice")
        .sortWithinPartitions("slice", F.desc("own"), "key", F.xxhash64("text"))
        .select("slice", "own", "doc_id", "text")
    )


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_PRINTS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_report(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Fingerprints of every row's text and edited text, and their likeness to each other and the next."""
    ordered = in_id_order(docs)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [c.split()[0] for c in _PRINTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        before = None
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("slice", "own", "doc_id", "text")]
            for part, own, doc_id, text in zip(*columns):
                text = text or ""
                now = (part, doc_id, text, slots(text, known))
                if before is not None and before[0] == part:
                    rows.append(_compared(before, now, known))
                before = now if own else None
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ordered.mapInArrow(run, _PRINTS)


def _compared(row: tuple, following: tuple, lexicon: Lexicon) -> tuple:
    _, doc_id, text, print_ = row
    new = edited(text, following[2])
    changed = slots(new, lexicon)
    return (
        doc_id,
        len(text),
        hashlib.sha256(new.encode()).hexdigest(),
        written(print_),
        written(changed),
        likeness(print_, changed),
        likeness(print_, following[3]),
    )


def fingerprints(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``fingerprint`` and its ``slots`` (null where empty) of every row, for joins on equal slots."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(t or "", shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([written(f) for f in found], pa.string()),
                    pa.array([[int(x) or None for x in f] for f in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "fingerprint", "slots"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, fingerprint string, slots array<bigint>")
