"""Byte-level BPE by recursive SQL: DuckDB contracts the new words of each partition.

A text is split by the public pattern; every match (word) is encoded on its
own. In the SQL a word is a run of token-position rows. Each round of the
recursion joins neighbouring rows with the merge table, takes per word the
leftmost pair of minimum rank, and contracts it, until no word has a pair left.
The merge table holds every pair of tokens whose bytes together are a token;
the rank of a pair is that token's id. Decoding joins ids with the vocabulary
and concatenates their bytes in an ordered aggregation.

Spark partitions the texts; within a worker process a word is contracted once
as long as the bounded memory of words holds it.

A round contracts one pair per word, so a word of n bytes takes up to n rounds
of n rows. Words of more than LONG bytes (runs of one sign, scripts without
spaces) would cost the square of their length that way; they are contracted
from the same merge table with a heap, by the same rule.

* A null or empty text has no ids. Special tokens are ordinary text.
* Rows are encoded one by one; repeated rows get equal ids.
"""

from __future__ import annotations

import hashlib
import heapq
import warnings
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import CUT, read_ranks
from lodestar.sources.storage import ship_package

#: Words per recursive query, and bytes of a word beyond which the heap is used.
BATCH, LONG = 40_000, 64
#: Words and space-free pieces that a worker remembers; characters handled together.
REMEMBERED, TOGETHER = 400_000, 4_000_000

ENCODE = """
WITH RECURSIVE state AS (
  SELECT (word::BIGINT << 20) | pos AS key, tok, 0 AS step FROM tokens
  UNION ALL
  (WITH pairs AS (
     SELECT key, tok, step, lead(tok) OVER w AS next_tok, lead(key) OVER w AS next_key, lag(key) OVER w AS before
     FROM state WINDOW w AS (ORDER BY key)
   ), ranked AS (
     SELECT key, tok, step, before, (m.id::BIGINT << 20) | (key & 1048575) AS pick
     FROM pairs p
     LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next_tok AND p.next_key >> 20 = p.key >> 20
   ), best AS (
     SELECT key >> 20 AS word, min(pick) AS pick FROM ranked GROUP BY 1 HAVING min(pick) IS NOT NULL
   )
   SELECT r.key, CASE WHEN r.key & 1048575 = b.pick & 1048575 THEN (b.pick >> 20)::INTEGER ELSE r.tok END, r.step + 1
   FROM ranked r JOIN best b ON b.word = r.key >> 20
   WHERE r.before IS NULL OR r.before <> ((b.word << 20) | (b.pick & 1048575)))
)
SELECT (key >> 20)::INTEGER AS word, list(tok ORDER BY key) AS ids
FROM state JOIN (SELECT key >> 20 AS done, max(step) AS last FROM state GROUP BY 1) ON done = key >> 20 AND last = step
GROUP BY 1 ORDER BY 1
"""

DECODE = """
SELECT word, string_agg(bytes, '' ORDER BY pos) AS bytes
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded) JOIN vocabulary USING (id)
GROUP BY word ORDER BY word
"""


def merge_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Left, right and id of every pair of tokens whose bytes are a token."""
    left, right, ids = [], [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                ids.append(rank)
    return left, right, ids


class Coder:
    """Encodes and decodes with one vocabulary, in a DuckDB of its own in this process."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        warnings.filterwarnings("ignore", message="Arrow output on a DB-API result")
        ranks = read_ranks(path)
        left, right, ids = merge_table(ranks)
        self._pairs = dict(zip(zip(left, right), ids))
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._split = regex.compile(pattern).findall
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        # Bytes travel as the characters of the same numbers.
        tables = {
            "merges": {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(ids, pa.int32())},
            "vocabulary": {
                "id": pa.array(list(ranks.values()), pa.int32()),
                "bytes": pa.array([t.decode("latin-1") for t in ranks], pa.string()),
            },
        }
        for name, columns in tables.items():
            self._db.register("source", pa.table(columns))
            self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
            self._db.unregister("source")
        self._words: dict[str, tuple[str, bytes]] = {}
        self._pieces: dict[str, tuple[str, bytes]] = {}
        self._heads: dict[str, tuple[str, bytes]] = {}

    def contract(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (not empty)."""
        data = [w.encode() for w in words]
        out: list[list[int]] = [[] for _ in words]
        short = [i for i, d in enumerate(data) if len(d) <= LONG]
        for at in range(0, len(short), BATCH):
            part = short[at : at + BATCH]
            sizes = np.array([len(data[i]) for i in part])
            codes = self._byte[np.frombuffer(b"".join(data[i] for i in part), dtype=np.uint8)]
            table = pa.table(
                {
                    "word": np.repeat(np.arange(len(part), dtype=np.int32), sizes),
                    "pos": (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
                    "tok": codes,
                }
            )
            self._db.register("tokens", table)
            found = self._db.execute(ENCODE).to_arrow_table()
            for i, ids in zip(part, found.column("ids").to_pylist()):
                out[i] = ids
        for i, d in enumerate(data):
            if len(d) > LONG:
                out[i] = self._contract_long(d)
        return out

    def _contract_long(self, data: bytes) -> list[int]:
        """The same rule with a heap of (rank, place) over a linked row of tokens."""
        tok = self._byte[np.frombuffer(data, dtype=np.uint8)].tolist()
        n = len(tok)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self._pairs.get((tok[i], tok[j]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, tok[i], tok[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, j, left, right = heapq.heappop(heap)
            if not (alive[i] and after[i] == j and j < n and tok[i] == left and tok[j] == right):
                continue
            tok[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t, a in zip(tok, alive) if a]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids."""
        rows = [i for i, x in enumerate(ids) if x]
        out = [b""] * len(ids)
        if rows:
            lists = pa.array([ids[i] for i in rows], pa.list_(pa.int32()))
            self._db.register("encoded", pa.table({"word": pa.array(rows, pa.int32()), "ids": lists}))
            for word, text in self._db.execute(DECODE).fetchall():
                out[word] = text.encode("latin-1")
        return out

    def _code_words(self, words: list[str]) -> dict[str, tuple[str, bytes]]:
        """Ids (decimal, by commas) and the bytes that they decode to."""
        ids = self.contract(words)
        return {w: (",".join(map(str, i)), b) for w, i, b in zip(words, ids, self.decode(ids))}

    def _code_pieces(self, pieces: list[str], lead: str) -> dict[str, tuple[str, bytes]]:
        split = [self._split(lead + p) for p in pieces]
        new = self._code_words(list({w for words in split for w in words}.difference(self._words)))
        both = _remember(self._words, new)
        out = {}
        for piece, words in zip(pieces, split):
            coded = [both[w] for w in words]
            out[piece] = ",".join([c[0] for c in coded]), b"".join([c[1] for c in coded])
        return out

    def _together(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        cut = [CUT.split(t) for t in texts]
        fresh: set[str] = set()
        for pieces in cut:
            fresh.update(set(pieces[1:]).difference(self._pieces))
        known = _remember(self._pieces, self._code_pieces(list(fresh), " "))
        heads = {p[0] for p in cut if p[0]}.difference(self._heads)
        first = _remember(self._heads, self._code_pieces(list(heads), ""))
        for pieces in cut:
            coded = [first[pieces[0]]] if pieces[0] else []
            coded.extend(map(known.__getitem__, pieces[1:]))
            yield ",".join([c[0] for c in coded]), b"".join([c[1] for c in coded])

    def code(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids (decimal, by commas) and the bytes decoded from them."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)


class _Both(dict):
    def __init__(self, known: dict, new: dict):
        super().__init__(new)
        self._known = known

    def __missing__(self, key):
        return self._known[key]


def _remember(known: dict, new: dict) -> dict:
    """``known`` with ``new`` added as far as its bound allows; else both of them for now."""
    if len(known) + len(new) <= REMEMBERED:
        known.update(new)
        return known
    return _Both(known, new)


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def bpe_report(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text, data in own.code([t or "" for t in batch.column("text").to_pylist()]):
                n.append(text.count(",") + bool(text))
                ids.append(hashlib.sha256(text.encode()).hexdigest())
                decoded.append(hashlib.sha256(data).hexdigest())
            arrays = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id``, ``ids`` of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            coded = own.code([t or "" for t in batch.column("text").to_pylist()])
            ids = [list(map(int, text.split(","))) if text else [] for text, _ in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id``, ``bytes`` of every row of ``doc_id``, ``ids`` (null: none)."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            found = own.decode([i or [] for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "bytes"]
            )

    slim = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids")
    return slim.mapInArrow(run, "doc_id bigint, bytes binary")
