"""Cost-balanced packing of token sequences.

A document is its token ids and an end mark. It is cut into full sequences and
a rest; rests of one packing group are then placed in descending order of
estimated cost, each into the sequence of lowest cost that still has room for
all of it. Cost is linear in the tokens plus quadratic per piece (attention
within a document). A rest that fits nowhere whole is cut over the sequences
with most room, so a group leaves less than one sequence of padding.

Groups are hash ranges of (doc_id, text); their number follows from the number
of documents, so a task holds a bounded number of short rests (GROUP on
average) and the result doesn't depend on how the input is laid out.

* A null or empty text is its end mark alone. Repeated rows are packed each.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import encoder
from lodestar.sources.storage import ship_package

#: Tokens of a sequence, the end mark, and documents per packing group.
LENGTH = 1024
END = 0
GROUP = 4096
#: Cost of a token, and of a pair of tokens of one piece.
LINEAR = 1.0
QUADRATIC = 1.0 / 512

Piece = tuple[int, int, int, int, int]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class _Rooms:
    """Open sequences by their room: a heap by cost for every room, and a tree of the least costs over the rooms."""

    def __init__(self, size: int, n: int):
        self._leaves = 1 << size.bit_length()
        self._heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        self._heaps[size] = [(0.0, s) for s in range(n)]
        self._least: list[tuple[float, int, int]] = [_NONE] * (2 * self._leaves)
        self._renew(size)

    def _renew(self, room: int) -> None:
        heap, least = self._heaps[room], self._least
        at = self._leaves + room
        least[at] = (*heap[0], room) if heap else _NONE
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def add(self, room: int, spent: float, s: int) -> None:
        heapq.heappush(self._heaps[room], (spent, s))
        self._renew(room)

    def take_cheapest(self, length: int) -> int | None:
        """Remove and return the cheapest sequence with room for ``length``; None without one."""
        lo, hi, best = self._leaves + length, 2 * self._leaves, _NONE
        while lo < hi:
            if lo & 1:
                best = min(best, self._least[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self._least[hi])
            lo >>= 1
            hi >>= 1
        if best is _NONE:
            return None
        _, s, room = best
        heapq.heappop(self._heaps[room])
        self._renew(room)
        return s


_NONE = (math.inf, -1, -1)


def place(lengths: list[int], size: int = LENGTH) -> list[list[tuple[int, int, int, int]]]:
    """For each rest its pieces ``(start, length, sequence, offset)``.

    ``lengths`` are below ``size``; ties keep the order given. As many
    sequences are open as the tokens need.
    """
    total = sum(lengths)
    n = -(-total // size)
    used, spent = [0] * n, [0.0] * n
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    rooms = _Rooms(size, n)

    def put(i: int, start: int, length: int, s: int) -> None:
        pieces[i].append((start, length, s, used[s]))
        used[s] += length
        spent[s] += cost(length)

    late = []
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        s = rooms.take_cheapest(lengths[i])
        if s is None:
            late.append(i)
            continue
        put(i, 0, lengths[i], s)
        if used[s] < size:
            rooms.add(size - used[s], spent[s], s)
    room = [(used[s] - size, s) for s in range(n) if used[s] < size]
    heapq.heapify(room)
    for i in late:
        start = 0
        while start < lengths[i]:
            free, s = heapq.heappop(room)
            take = min(-free, lengths[i] - start)
            put(i, start, take, s)
            start += take
            if free + take < 0:
                heapq.heappush(room, (free + take, s))
    return pieces


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_CUT = "grp int, doc_id bigint, hash bigint, start bigint, length bigint, doc_tokens bigint, crc bigint, ids binary"
_PACKED = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, group_id int, piece_cost double"
)


def cut_documents(
    docs: DataFrame, tokenizer: str, groups: int, size: int = LENGTH, special: str | None = None
) -> DataFrame:
    """Full pieces (with checksum) and rests (with ids) of every row, under its group."""
    ship_package(docs.sparkSession)
    names = _CUT.replace("bigint", "").replace("int", "").replace("binary", "")
    names = [n.strip() for n in names.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, special)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            columns = [batch.column(c).to_pylist() for c in ("grp", "doc_id", "hash")]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for grp, doc_id, code, ids in zip(*columns, own.encode_all(texts)):
                ids = np.append(ids, np.uint16(END))
                n = len(ids)
                end = n - n % size
                for start in range(0, end, size):
                    rows.append((grp, doc_id, code, start, size, n, _crc(ids[start : start + size]), None))
                if end < n:
                    rows.append((grp, doc_id, code, end, n - end, n, None, ids[end:].astype("<u2").tobytes()))
                held += n
                if held > 4_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        columns = list(zip(*rows)) or [()] * len(types)
        arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.xxhash64("doc_id", "text").alias("hash"),
    ).withColumn("grp", F.pmod("hash", F.lit(groups)).cast("int"))
    return slim.mapInArrow(run, _CUT)


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = LENGTH, group: int = GROUP, special: str | None = None
) -> DataFrame:
    """One row per piece; ``sequence_id`` is unique over all groups.

    ``tokenizer`` is a rank file; ``special`` a tokenizer file whose special tokens
    keep their ids where they stand in a text (without it they are ordinary text).
    """
    groups = max(1, -(-docs.count() // group))
    pieces = cut_documents(docs, tokenizer, groups, size, special)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hash", "doc_id", "start"], kind="stable", na_position="first")
        number = int(rows["grp"].iloc[0])
        out = []
        rests = []
        sequence = 0
        for row in rows.itertuples(index=False):
            doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
            if row.ids is None:
                out.append((doc_id, row.start, row.length, int(row.crc), row.doc_tokens, sequence, 0))
                sequence += 1
            else:
                rests.append((doc_id, row))
        for (doc_id, row), parts in zip(rests, place([int(r.length) for _, r in rests], size)):
            ids = np.frombuffer(row.ids, dtype="<u2")
            for start, length, s, offset in parts:
                crc = _crc(ids[start : start + length])
                out.append((doc_id, row.start + start, length, crc, row.doc_tokens, sequence + s, offset))
        frame = pd.DataFrame(
            out,
            columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame["sequence_id"] += number << 32
        frame["group_id"] = np.int32(number)
        frame["piece_cost"] = LINEAR * frame["length"] + QUADRATIC * frame["length"] ** 2
        return frame

    return pieces.groupBy("grp").applyInPandas(pack, _PACKED)
