"""Substring de-duplication of repeated word windows behind a count-min prefilter.

A window is WINDOW consecutive words of one document. Words covered by a window
whose word sequence also starts earlier (smaller doc_id, or same document and
earlier start) are removed.

First pass: every task sketches its windows. A window is counted under its
anchor, the run of GRAM words inside it with the least hash; neighbouring
windows share anchors, so a sketch holds about a seventh of the windows. Two
windows of equal words have anchors of equal words at different places, so the
count of an anchor is never below the count of a window. Task sketches are
merged by adding cells (ROWS rows of 2^BITS cells), and the least cell of an
anchor over the rows overestimates its count. Only "twice or more" matters:
one bit per cell, ROWS x 2^BITS / 8 bytes in all, is what the second pass gets.

Second pass: windows estimated repeated are grouped exactly by a 96-bit hash
of their words; none that repeats is missed. A task passes on its first
occurrence of a window only, so no group has more rows than there are tasks.

Where the sketch is too small for the corpus, more windows reach the exact
grouping; results don't change.

* A null or empty text has no words; so do texts of space only.
* A null doc_id comes before all others. Rows that repeat a doc_id repeat the
  document: they don't count as earlier occurrences of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.storage import ship_package

WINDOW, GRAM = 20, 8
#: Rows of the sketch, and its cells per row as a power of two.
ROWS, BITS = 2, 27
#: Slices of a row in which task sketches are merged.
MERGED = 64
#: Bytes of text hashed together, anchors per partial sketch, windows kept for local grouping.
TOGETHER, ANCHORS, HELD = 1_500_000, 1_500_000, 1_000_000
_LEAST = -(1 << 63)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(256, dtype=np.uint64), 99)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as long as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, self.base, dtype=np.uint64)
            back = np.full(size, self.inverse, dtype=np.uint64)
            steps[0] = back[0] = 1
            self._up, self._down = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return self._up[:n], self._down[:n]


_OF_BYTES = _Powers(0x5851F42D4C957F2D)
_OF_WORDS = (_Powers(0x2545F4914F6CDD1D), _Powers(0xD1342543DE82EF95))


def _runs(values: np.ndarray, powers: _Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of every range [start, end) of ``values``, the same wherever it stands."""
    up, down = powers.first(max(len(values), 1))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:], dtype=np.uint64)
    return (sums[ends] - sums[starts]) * down[starts]


class Windows:
    """Words and windows of some texts, hashed together.

    ``doc`` and ``start`` tell for each window the text and the word it starts
    at; ``anchor`` is the place of its anchor among all grams.
    """

    def __init__(self, texts: list[bytes], need_hashes: bool = True):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        bounds = np.cumsum(lengths)
        doc = np.searchsorted(bounds, starts, side="right")
        self.n_words = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(self.n_words) - self.n_words
        words = _mixed(_runs(_BYTE[data], _OF_BYTES, starts, ends), 1)
        n = len(words)
        at = np.arange(max(n - WINDOW + 1, 0))
        at = at[doc[at] == doc[at + WINDOW - 1]] if n >= WINDOW else at[:0]
        self.doc, self.start = doc[at], at - first[doc[at]]
        grams = np.arange(max(n - GRAM + 1, 0))
        self.grams = _mixed(_runs(words, _OF_WORDS[0], grams, grams + GRAM), 2)
        self.anchor = self._anchors(at)
        self.low = self.high = np.zeros(0, dtype=np.uint64)
        self._words, self._at = words, at

    def _anchors(self, at: np.ndarray) -> np.ndarray:
        """Leftmost least gram of each window."""
        best = self.grams[at]
        where = at.copy()
        for k in range(1, WINDOW - GRAM + 1):
            other = self.grams[at + k]
            less = other < best
            best = np.where(less, other, best)
            where[less] = at[less] + k
        return where

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the words of the chosen windows."""
        at = self._at[chosen]
        low = _mixed(_runs(self._words, _OF_WORDS[0], at, at + WINDOW), 3)
        high = _mixed(_runs(self._words, _OF_WORDS[1], at, at + WINDOW), 4)
        return low.view(np.int64), (high >> np.uint64(33)).astype(np.int32)


def cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mixed(grams, 10 + row) >> np.uint64(64 - bits)).astype(np.int64)


def _squeezed(sorted_cells: np.ndarray) -> bytes:
    """Sorted cell numbers below 2^32 as compressed differences."""
    steps = np.diff(np.r_[0, sorted_cells]).astype("<u4")
    # Bytes of equal weight stand together: the upper ones are mostly zero.
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueezed(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids (null: the least number) and texts, TOGETHER bytes at a time."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(_LEAST if doc_id is None else doc_id)
            texts.append((text or "").encode())
            size += len(texts[-1])
            if size >= TOGETHER:
                yield ids, texts
                ids, texts, size = [], [], 0
    yield ids, texts


def repeated_cells(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """Merged sketch as bits: (row, cell) is set if the cell counts two anchors or more."""
    ship_package(docs.sparkSession)
    width = 1 << bits
    part = width // MERGED

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, texts in _chunks(batches):
            found = Windows(texts)
            held.append(found.grams[np.unique(found.anchor)])
            size += len(held[-1])
            if size >= ANCHORS:
                yield partial(np.concatenate(held))
                held, size = [], 0
        if held:
            yield partial(np.concatenate(held))

    def partial(grams: np.ndarray) -> pa.RecordBatch:
        rows, parts, once, twice = [], [], [], []
        for row in range(ROWS):
            found, counts = np.unique(cells(grams, row, bits), return_counts=True)
            cuts = np.searchsorted(found, np.arange(1, MERGED) * part)
            for k, (own, many) in enumerate(zip(np.split(found, cuts), np.split(counts > 1, cuts))):
                if len(own):
                    rows.append(row)
                    parts.append(k)
                    once.append(_squeezed(own[~many] - k * part))
                    twice.append(_squeezed(own[many] - k * part))
        arrays = [pa.array(rows, pa.int32()), pa.array(parts, pa.int32())]
        arrays += [pa.array(once, pa.binary()), pa.array(twice, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "part", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the sketches of one (row, part) after the other; input is sorted by them."""
        key, total = None, np.zeros(0, dtype=np.uint8)
        for batch in batches:
            for row, k, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (row, k):
                    if key is not None:
                        yield merged(key, total)
                    key, total = (row, k), np.zeros(part, dtype=np.uint8)
                one = _unsqueezed(once)
                total[one] = np.minimum(total[one] + 1, 2)
                total[_unsqueezed(twice)] = 2
        if key is not None:
            yield merged(key, total)

    def merged(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        blob = np.packbits(total > 1, bitorder="little").tobytes()
        arrays = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([blob], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "part", "bits"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = slim.mapInArrow(sketch, "row int, part int, once binary, twice binary")
    whole = (
        sketches.repartition("row", "part")
        .sortWithinPartitions("row", "part")
        .mapInArrow(merge, "row int, part int, bits binary")
    )
    out = np.zeros((ROWS, width // 8), dtype=np.uint8)
    # ROWS x MERGED rows of fixed size.
    for r in whole.collect():
        at = r["part"] * part // 8
        out[r["row"], at : at + part // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def estimated_repeated(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Whether the least cell of each gram counts two or more."""
    bits = (sketch.shape[1] * 8).bit_length() - 1
    yes = np.ones(len(grams), dtype=bool)
    for row in range(ROWS):
        cell = cells(grams[yes], row, bits)
        yes[yes] = (sketch[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return yes


def later_windows(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``first``, ``end``: word ranges covered by windows that also start earlier.

    The least number stands for a null doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for ids, texts in _chunks(batches):
            found = Windows(texts)
            places, which = np.unique(found.anchor, return_inverse=True)
            chosen = np.flatnonzero(estimated_repeated(found.grams[places], sketch)[which])
            low, high = found.hashes(chosen)
            doc = np.array(ids, dtype=np.int64)[found.doc[chosen]] if len(chosen) else np.zeros(0, dtype=np.int64)
            held.append((low, high, doc, found.start[chosen].astype(np.int32)))
            size += len(chosen)
            if size >= HELD:
                yield from grouped(held)
                held, size = [], 0
        yield from grouped(held)

    def grouped(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The first window of each word sequence as a candidate; the covered ranges of the others."""
        if not held:
            return
        low, high, doc, start = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((start, doc, high, low))
        low, high, doc, start = low[order], high[order], doc[order], start[order]
        new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(low)]
        lead = np.flatnonzero(new)
        mine = np.repeat(lead, np.diff(np.r_[lead, len(low)]))
        # Rows that repeat a document stand at its place and are not later.
        later = (doc != doc[mine]) | (start != start[mine])
        yield _found(low[new], high[new], doc[new], start[new], None)
        ranges = _ranges(doc[later], start[later])
        salt = _mixed(ranges[0].view(np.uint64), 5).view(np.int64)
        yield _found(salt, np.full(len(salt), -1, dtype=np.int32), *ranges)

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        candidates, "low bigint, high int, doc_id bigint, first int, end int"
    )
    # Ranges found within a task travel with the candidates, so that texts are read once.
    place = F.struct("doc_id", "first")
    least = F.min(place).over(Window.partitionBy("low", "high"))
    ranges = found.withColumn("least", least).where(F.col("end").isNotNull() | (place != F.col("least")))
    return ranges.select("doc_id", "first", F.coalesce("end", F.col("first") + WINDOW).alias("end"))


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each document joined to the word ranges that they cover."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    if not len(doc):
        return doc, start.astype(np.int32), start.astype(np.int32)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + WINDOW)]
    lead = np.flatnonzero(new)
    last = np.r_[lead[1:], len(doc)] - 1
    return doc[lead], start[lead].astype(np.int32), (start[last] + WINDOW).astype(np.int32)


def _found(low, high, doc, first, end) -> pa.RecordBatch:
    ends = pa.nulls(len(low), pa.int32()) if end is None else pa.array(end, pa.int32())
    arrays = [pa.array(low, pa.int64()), pa.array(high, pa.int32()), pa.array(doc, pa.int64())]
    return pa.RecordBatch.from_arrays(
        [*arrays, pa.array(first, pa.int32()), ends], names=["low", "high", "doc_id", "first", "end"]
    )


def kept_words(text: str | None, ranges: list) -> tuple[list[bytes], int]:
    """Words outside the ranges, and how many words there were."""
    words = (text or "").encode().split()
    if not ranges:
        return words, len(words)
    keep = np.ones(len(words), dtype=bool)
    for r in ranges:
        keep[r["first"] : r["end"]] = False
    return list(compress(words, keep.tolist())), len(words)


def _with_ranges(docs: DataFrame, bits: int) -> DataFrame:
    """``docs`` with the ranges of each document; a document's ranges are no longer than its text."""
    ranges = (
        later_windows(docs, bits)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.collect_list(F.struct("first", "end")).alias("_ranges"))
    )
    return docs.join(ranges, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)) == F.col("_id"), "left")


def substring_report(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("_ranges").to_pylist()):
                kept, n = kept_words(text, ranges)
                total.append(n)
                gone.append(n - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            arrays = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = _with_ranges(slim, bits).select("doc_id", "text", "_ranges")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with repeated passages taken out; changed texts are their kept words, one space apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("_ranges").to_pylist())
            new = [b" ".join(kept_words(t, r)[0]).decode() if r else t for t, r in pairs]
            kind = batch.schema.field("text").type
            yield pa.RecordBatch.from_arrays([batch.column("others"), pa.array(new, kind)], names=["others", "text"])

    # The caller's other columns travel as one, so that none can clash with those made here.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    packed = docs.select(others, "doc_id", "text")
    joined = _with_ranges(packed, bits).select("others", "text", "_ranges")
    kept = joined.mapInArrow(run, packed.select("others", "text").schema)
    return kept.select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns])
