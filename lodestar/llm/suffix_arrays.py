"""Benchmark decontamination by suffix arrays of the training text.

Training texts are cut into words and gathered into shards. A shard numbers its
words, puts a mark of its own after every text, and builds the suffix array of
these numbers: packed keys of the first few words are sorted, and only suffixes
that still tie are sorted again by the ranks twice as far ahead.

Every suffix of a benchmark item that starts a window is searched in every
shard by binary search, word after word: its range of the suffix array narrows
until it is empty. The range at the length of the window holds all places where
the window occurs; the last range that isn't empty gives the longest verbatim
match and where it stands. Documents with a match are affected.

A window is WINDOW consecutive words of an item; an item of fewer words, but not
none, is one window. Words are runs of ASCII letters (A-Z lower-cased), digits
and characters beyond ASCII.

Items are the query set: they come in blocks of at most BLOCK bytes of text (one
item at least). A block is broadcast and searched against all shards; nothing
about the training text leaves a task but the result of each row. Shards are
built anew for every further block rather than stored, which would take eight
bytes a word. A text of over PIECE words is searched in pieces that overlap by
the longest item of the block.

* A null or empty text has no words and is never affected; a null or empty item
  has no windows.
* Rows that repeat a doc_id or a text are judged each. Rows of one item_id are
  one item; a null item_id is the name ``null``.
* Without items no document is affected.
* Columns of the caller are left as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import cut_lineage, ship_package

WINDOW = 10
#: Bytes of item text that are searched in one pass.
BLOCK = 16_000_000
#: Bytes of training text in a shard, and words of one text that are searched together.
SHARD, PIECE = 4_000_000, 1_000_000
#: Bytes that are cut into words at a time.
SLICE = 1_000_000

#: Word bytes stay, capitals become small, all else is space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class _Numbers(defaultdict):
    """Words numbered in the order they come."""

    def __init__(self) -> None:
        super().__init__(count().__next__)

    def of(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words; slices end between words."""
        data = text.translate(_WORD_BYTES)
        parts, at = [], 0
        while at < len(data):
            end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = end
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])


@dataclass
class Items:
    """A block of items: their distinct words, and where windows start.

    ``ids`` are the items' words one after the other; window ``i`` starts at
    ``start[i]``, is ``need[i]`` words long, and its item goes on for ``rest[i]``
    words in all. ``item[i]`` is its item's place in ``names``, ``offset[i]`` its
    own first word in the item.
    """

    words: list[bytes]
    ids: np.ndarray
    start: np.ndarray
    need: np.ndarray
    rest: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    names: list[str]

    @property
    def longest(self) -> int:
        return int(self.rest.max(initial=1))


def item_block(rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> Items:
    numbers, names = _Numbers(), {}
    ids, start, need, rest, item, offset = [], [], [], [], [], []
    at = 0
    for name, text in rows:
        own = numbers.of(text)
        if not len(own):
            continue
        place = names.setdefault("null" if name is None else name, len(names))
        n = min(window, len(own))
        first = np.arange(len(own) - n + 1)
        ids.append(own)
        start.append(at + first)
        need.append(np.full(len(first), n))
        rest.append(len(own) - first)
        item.append(np.full(len(first), place))
        offset.append(first)
        at += len(own)
    lists = (ids, start, need, rest, item, offset)
    joined = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in lists]
    return Items(list(numbers), *joined, list(names))


def item_blocks(items: DataFrame, key: str, text: str, window: int = WINDOW, size: int = BLOCK) -> Iterator[Items]:
    """The items in blocks; the driver holds one block at a time."""
    rows: list[tuple[str | None, bytes]] = []
    held = 0
    for r in items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        data = (r["t"] or "").encode()
        if rows and held + len(data) > size:
            yield item_block(rows, window)
            rows, held = [], 0
        rows.append((r["k"], data))
        held += len(data)
    yield item_block(rows, window)


class Shard:
    """Words of some training texts and their suffix array.

    Words are ordered by their first occurrence, after the marks that end the
    texts: any order of words serves a binary search. ``first`` is where each
    text starts.
    """

    def __init__(self, numbers: _Numbers, texts: list[np.ndarray]):
        self.numbers = numbers
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        data = np.empty(int(lengths.sum()) + len(texts), dtype=np.int64)
        ends = self.first + lengths
        data[ends] = np.arange(len(texts))
        inside = np.ones(len(data), dtype=bool)
        inside[ends] = False
        data[inside] = np.concatenate(texts) + np.int64(len(texts))
        self.data = data
        top = len(texts) + len(numbers)
        self.suffixes = suffix_array(data, top)
        # Suffixes by their first word: the slots of word w are bucket[w] to bucket[w + 1].
        self.bucket = np.r_[0, np.cumsum(np.bincount(data, minlength=top))]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """Per range the first slot whose word at ``depth`` is not below (``after``: above) the given one."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            found = self.data[self.suffixes[mid] + depth]
            below = found <= word[open_] if after else found < word[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def search(self, block: Items) -> Found:
        """The windows of the block that occur here, with their slots and longest matches."""
        known = np.array([self.numbers.get(w, -1) for w in block.words], dtype=np.int64)
        known[known >= 0] += len(self.first)
        ids = known[block.ids]
        word = ids[block.start]
        own = np.flatnonzero(word >= 0)
        lo, hi = self.bucket[word[own]], self.bucket[word[own] + 1]
        own, lo, hi = (x[lo < hi] for x in (own, lo, hi))
        n = len(block.start)
        at_need = np.zeros((2, n), dtype=np.int64)
        length, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        depth = 1
        while len(own):
            full = block.need[own] == depth
            at_need[0, own[full]], at_need[1, own[full]] = lo[full], hi[full]
            length[own], place[own] = depth, self.suffixes[lo]
            on = block.rest[own] > depth
            own, lo, hi = own[on], lo[on], hi[on]
            word = ids[block.start[own] + depth]
            on = word >= 0
            own, lo, hi, word = own[on], lo[on], hi[on], word[on]
            # No text is left before its mark, so a slot's place plus depth is inside the data.
            lo = self._bound(lo, hi, depth, word, False)
            hi = self._bound(lo, hi, depth, word, True)
            on = lo < hi
            own, lo, hi = own[on], lo[on], hi[on]
            depth += 1
        own = np.flatnonzero(at_need[1] > at_need[0])
        return Found(own, at_need[0, own], at_need[1, own], length[own], place[own])


@dataclass
class Found:
    """Windows that occur (``own``), their slots ``lo`` to ``hi``, and each longest match with one place of it."""

    own: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    length: np.ndarray
    place: np.ndarray


def suffix_array(data: np.ndarray, top: int) -> np.ndarray:
    """Starts of all suffixes of numbers below ``top`` in ascending order; no two suffixes are equal."""
    n = len(data)
    bits = max(1, int(top).bit_length())
    ahead = max(1, min(16, 63 // bits))
    padded = np.r_[data, np.zeros(ahead, dtype=np.int64)]
    key = padded[:n].copy()
    for k in range(1, ahead):
        key <<= bits
        key |= padded[k : n + k]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]][:n]
    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n)
    lead = np.maximum.accumulate(np.where(new, slots, 0))
    rank[order] = lead
    alone = new & np.r_[new[1:], True][:n]
    tied = slots[~alone]
    while len(tied):
        mine = order[tied]
        later = mine + ahead
        far = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[mine] * (n + 1) + far
        by = np.argsort(key)
        order[tied] = mine[by]
        key = key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        # Groups of ties stand in slots of their own, so a group's first slot is its rank.
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        alone = new & np.r_[new[1:], True]
        tied = tied[~alone]
        ahead *= 2
    return order


@dataclass
class Row:
    """What is known of a document: its words, covered word ranges, names of items."""

    n_words: int
    spans: list[tuple[int, int]]
    items: set[str]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending ranges of the same cover."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def shards(texts: list[bytes], block: Items) -> Iterator[tuple[Shard, list[tuple[int, int]]]]:
    """Shards of the texts, each with (text, first word) of its pieces."""
    numbers = _Numbers()
    held: list[np.ndarray] = []
    places: list[tuple[int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        ids = numbers.of(text)
        for first in range(0, len(ids), PIECE):
            piece = ids[first : first + PIECE + block.longest - 1]
            if held and size + len(piece) > PIECE:
                yield Shard(numbers, held), places
                held, places, size = [], [], 0
            held.append(piece)
            places.append((i, first))
            size += len(piece)
    if held:
        yield Shard(numbers, held), places


def judge(texts: list[bytes], block: Items) -> list[Row]:
    """Covered words and items of every text."""
    rows = [Row(0, [], set()) for _ in texts]
    for shard, places in shards(texts, block):
        ends = np.r_[shard.first[1:], len(shard.data)]
        for (i, first), words in zip(places, (ends - shard.first - 1).tolist()):
            rows[i].n_words = max(rows[i].n_words, first + words)
        _add(shard, shard.search(block), places, block, rows)
    for row in rows:
        row.spans = merged(row.spans)
    return rows


def _add(shard: Shard, found: Found, places: list[tuple[int, int]], block: Items, rows: list[Row]) -> None:
    """Add what one shard holds of the block to its rows."""
    if not len(found.own):
        return
    # Equal windows have the same slots; they are followed once, for all items that hold them.
    classes = np.stack([found.lo, found.hi, block.need[found.own]])
    (lo, hi, need), kind = np.unique(classes, axis=1, return_inverse=True)
    kind = kind.ravel()
    item = block.item[found.own]
    by = np.lexsort((item, kind))
    sets: dict[bytes, int] = {}
    cuts = np.flatnonzero(np.diff(kind[by])) + 1
    own_set = np.array([sets.setdefault(np.unique(h).tobytes(), len(sets)) for h in np.split(item[by], cuts)])
    names = [{block.names[i] for i in np.frombuffer(s, dtype=np.int64)} for s in sets]
    cover = np.zeros(len(shard.data) + 1, dtype=np.int64)
    pairs = []
    for n in np.unique(need):
        # Different windows of one length have no place in common.
        mine = np.flatnonzero(need == n)
        sizes = hi[mine] - lo[mine]
        slot = np.repeat(lo[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        at = shard.suffixes[slot]
        cover[at] += 1
        cover[at + n] -= 1
        pairs.append(np.unique(shard.text_of(at) * len(names) + np.repeat(own_set[mine], sizes)))
    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(cover) > 0].view(np.int8)))
    first, end = edges[0::2], edges[1::2]
    text = shard.text_of(first)
    for t, a, b in zip(text.tolist(), (first - shard.first[text]).tolist(), (end - shard.first[text]).tolist()):
        rows[places[t][0]].spans.append((places[t][1] + a, places[t][1] + b))
    for pair in np.unique(np.concatenate(pairs)).tolist():
        rows[places[pair // len(names)][0]].items |= names[pair % len(names)]


def _texts(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in order with their texts, about SHARD bytes (one text at least) at a time."""
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + SHARD, side="right")))
            yield batch.slice(at, stop - at), _texts(column.slice(at, stop - at))
            at = stop


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_FOUND = "doc_id bigint, n_words bigint, spans array<struct<first: bigint, end: bigint>>, items array<string>"


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    size: int = BLOCK,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (disjoint covered word ranges), ``items`` (sorted names) of every row."""
    sc = docs.sparkSession.sparkContext
    ship_package(docs.sparkSession)
    known = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<first: bigint, end: bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        F.col(text).alias("text"),
    )
    for number, block in enumerate(item_blocks(items, item_key, item_text, window, size)):
        if number:
            # Only one block is in a worker's memory at a time.
            known = cut_lineage(known)
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, texts in _slices(batches, "text"):
                found = judge(texts, shared.value)
                old = zip(rows.column("spans").to_pylist(), rows.column("items").to_pylist())
                spans, names = [], []
                for row, (before, held) in zip(found, old):
                    spans.append(merged([*row.spans, *((s["first"], s["end"]) for s in before)]))
                    names.append(sorted(row.items.union(held)))
                arrays = [
                    rows.column("doc_id"),
                    pa.array([row.n_words for row in found], pa.int64()),
                    pa.array(spans, _SPANS),
                    pa.array(names, pa.list_(pa.string())),
                    rows.column("text"),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=rows.schema.names)

        known = known.mapInArrow(run, f"{_FOUND}, text string")
    return known.drop("text")


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    size: int = BLOCK,
) -> DataFrame:
    """The longest verbatim match of every item suffix that starts with an occurring window.

    ``item``, ``offset`` (its first word in the item), ``length`` (words), and a
    place of the match: ``doc_id``, ``first``. Of equally long matches the one
    with the smallest doc_id counts. A task passes on one row per suffix.
    """
    sc = docs.sparkSession.sparkContext
    ship_package(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in item_blocks(items, item_key, item_text, window, size):
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best: dict[int, tuple] = {}
            for rows, texts in _slices(batches, "text"):
                ids = rows.column("doc_id").to_pylist()
                for shard, places in shards(texts, own):
                    found = shard.search(own)
                    text = shard.text_of(found.place)
                    columns = (found.own, found.length, text, found.place - shard.first[text])
                    for w, length, t, at in zip(*(c.tolist() for c in columns)):
                        doc = ids[places[t][0]]
                        entry = (length, doc is not None, -(doc or 0), -(places[t][1] + at))
                        best[w] = max(best.get(w, entry), entry)
            keys = list(best)
            arrays = [
                pa.array([own.names[own.item[w]] for w in keys], pa.string()),
                pa.array([int(own.offset[w]) for w in keys], pa.int64()),
                pa.array([best[w][0] for w in keys], pa.int64()),
                pa.array([-best[w][2] if best[w][1] else None for w in keys], pa.int64()),
                pa.array([-best[w][3] for w in keys], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "offset", "length", "doc_id", "first"])

        one = slim.mapInArrow(run, "item string, offset bigint, length bigint, doc_id bigint, first bigint")
        out = one if out is None else out.unionAll(one)
    rank = F.struct("length", F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("first"))
    best = F.max_by(F.struct("length", "doc_id", "first"), rank).alias("m")
    return out.groupBy("item", "offset").agg(best).select("item", "offset", "m.*")


def remove_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    size: int = BLOCK,
) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    sc = docs.sparkSession.sparkContext
    ship_package(docs.sparkSession)
    for number, block in enumerate(item_blocks(items, item_key, item_text, window, size)):
        if number:
            docs = cut_lineage(docs)
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, texts in _slices(batches, text):
                yield rows.filter(pa.array([not row.spans for row in judge(texts, shared.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
