"""SimHash near-duplicates: fingerprints, a binary-trie self-join, components.

A text is lower-cased (A-Z) and cut into words and word shingles; a bit of its
fingerprint is set if over half of the shingles' XXH64 hashes have it.

Distinct fingerprints that differ in at most BUDGET of 64 bits are linked. With
64 bits in four blocks of 16, such a pair agrees in one block at least, so the
self-join of the binary trie starts, once for each block, at the subtrees that
hold an agreed block: below it, pairs of nodes descend together, differing bits
add up, and a pair is left as soon as it exceeds the budget. Subtrees with over
HOT fingerprints agree in a twelfth of bits more (four sub-blocks of the other
48) and are split accordingly, which spreads them over tasks.

A pair of nodes is also left when all their leaves are known to be connected,
so a dense cluster doesn't cost the square of its size, and only links that
join something leave a task. No link is lost for the components.

One fingerprint of 64 bits finds a pair within the budget by chance: bits whose
counts are nearly even flip. With several ROUNDS a text gets as many independent
fingerprints (the shingle hashes are scrambled anew for each), and texts are
linked if any of them are; the components are those of the union.

* A null or empty text has fingerprint zero, which links like any other.
* Fewer words than a shingle: the whole word sequence is the only shingle.
* Equal texts share a fingerprint; they never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import connected_components
from lodestar.sources.storage import cut_lineage, ship_package

SHINGLE = 3
BUDGET = 3
BLOCKS, BLOCK_BITS = 4, 16
SUB_BLOCKS, SUB_BITS = 4, 12
#: Fingerprints of a subtree beyond which it is split by sub-blocks.
HOT = 256
SEED = 42
#: Rows that one traversal takes together, and node pairs it follows at a time.
CHUNK, FRONT = 100_000, 200_000


def _scrambled(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Hashes of the given round: as they are in the first, mixed with its number later."""
    if not turn:
        return hashes
    x = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint."""
    return simhashes(text, shingle)[0]


def simhashes(text: str | None, shingle: int = SHINGLE, rounds: int = 1) -> list[int]:
    """Unsigned 64-bit fingerprints of every round."""
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * rounds
    data = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)
    out = []
    for turn in range(rounds):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 65_536):
            part = _scrambled(hashes[at : at + 65_536], turn).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = (2 * ones > n).astype(np.uint64)
        out.append(int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)))
    return out


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, rounds: int = 1, key: Column | None = None
) -> DataFrame:
    """``doc_id`` (or ``key`` under that name), ``fps`` (a fingerprint per round, signed 64-bit) of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhashes(t, shingle, rounds) for t in batch.column("text").to_pylist()]
            flat = np.array(found, dtype=np.uint64).view(np.int64).ravel()
            places = pa.array(np.arange(len(found) + 1) * rounds, pa.int32())
            lists = pa.ListArray.from_arrays(places, pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "fps"])

    key = F.col("doc_id").cast("bigint") if key is None else key
    slim = docs.select(key.alias("doc_id"), "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fps array<bigint>")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index connected to each of ``n`` indexes by the links ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def trie_links(
    key: np.ndarray, rest: np.ndarray, bits: int, budget: int = BUDGET, dense: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index pairs) among rows of equal ``key`` whose ``rest`` differ in <= budget bits.

    Rows are sorted by (key, rest) and distinct. A trie node is a range of rows
    that agree in their leading bits; a range is cut at a bit by counting zeros.
    """
    n = len(rest)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], n]
    several = last - first > 1
    first, last = first[several], last[several]
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # In dense subtrees, leaves one bit apart are found by lookup first, so that
    # most clusters are known before the descent.
    a = b = np.zeros(0, dtype=np.int64)
    if dense:
        run = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        full = (run.astype(np.uint64) << np.uint64(bits)) | rest
        for bit in range(bits):
            other = full ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(full, other), n - 1)
            near = np.flatnonzero((full[at] == other) & (at > np.arange(n)))
            a, b = np.r_[a, near], np.r_[b, at[near]]
    zeros = {}

    def zeros_before(level: int) -> np.ndarray:
        if level not in zeros:
            bit = (rest >> np.uint64(bits - 1 - level)) & np.uint64(1)
            zeros[level] = np.r_[0, np.cumsum(bit == 0)]
        return zeros[level]

    root = _roots(a, b, n)
    changes = np.r_[0, np.cumsum(root[1:] != root[:-1])]

    stack = [(0, first, last, first, last, np.zeros(len(first), dtype=np.int8))]
    while stack:
        level, al, ah, bl, bh, used = stack.pop()
        if len(al) > FRONT:
            half = len(al) // 2
            stack.append((level, *(x[half:] for x in (al, ah, bl, bh, used))))
            al, ah, bl, bh, used = (x[:half] for x in (al, ah, bl, bh, used))
        if level == bits:
            a, b = np.r_[a, al], np.r_[b, bl]
            root = _roots(a, b, n)
            changes = np.r_[0, np.cumsum(root[1:] != root[:-1])]
            continue
        count = zeros_before(level)
        am, bm = al + count[ah] - count[al], bl + count[bh] - count[bl]
        own = (al == bl) & (ah == bh)
        apart = used + 1
        parts = [
            (al, am, bl, bm, used, np.ones(len(al), dtype=bool)),
            (am, ah, bm, bh, used, np.ones(len(al), dtype=bool)),
            (al, am, bm, bh, apart, np.ones(len(al), dtype=bool)),
            (am, ah, bl, bm, apart, ~own),
        ]
        found = []
        for lo, hi, lo2, hi2, u, ok in parts:
            ok = ok & (hi > lo) & (hi2 > lo2) & (u <= budget) & ~((lo == lo2) & (hi - lo == 1))
            lo, hi, lo2, hi2, u = lo[ok], hi[ok], lo2[ok], hi2[ok], u[ok]
            one = (changes[lo] == changes[hi - 1]) & (changes[lo2] == changes[hi2 - 1]) & (root[lo] == root[lo2])
            found.append(tuple(x[~one] for x in (lo, hi, lo2, hi2, u)))
        merged = [np.concatenate([f[i] for f in found]) for i in range(5)]
        if len(merged[0]):
            stack.append((level + 1, *merged))
    return a, b


#: Where a key holds its round, above sub-block, block and bits.
_TURN = 40


def _join_runs(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by (sub, key, rest); runs of equal (sub, key) are kept together."""
    held: list[np.ndarray] = []
    size = 0

    def links(table: np.ndarray) -> pa.RecordBatch:
        sub, key, rest, fp = table
        out_a, out_b, turns = [], [], []
        for kind, bits in ((0, 64 - BLOCK_BITS), (1, 64 - BLOCK_BITS - SUB_BITS)):
            # Runs of unsplit subtrees and of sub-blocks have tries of different depth.
            mine = np.flatnonzero((sub >= 0) == bool(kind))
            if not len(mine):
                continue
            a, b = trie_links(key[mine], rest[mine].view(np.uint64), bits, budget, bool(kind))
            root = _roots(a, b, len(mine))
            member = np.flatnonzero(root != np.arange(len(mine)))
            out_a.append(fp[mine[member]])
            out_b.append(fp[mine[root[member]]])
            turns.append(key[mine[member]] >> _TURN)
        empty = np.zeros(0, dtype=np.int64)
        arrays = [pa.array(np.concatenate([empty, *x])) for x in (turns, out_a, out_b)]
        return pa.RecordBatch.from_arrays(arrays, names=["turn", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(c).to_numpy() for c in ("sub", "key", "rest", "fp")]))
        size += batch.num_rows
        if size >= CHUNK:
            table = np.concatenate(held, axis=1)
            # The last run may go on in the next batch.
            same = (table[0] == table[0, -1]) & (table[1] == table[1, -1])
            cut = len(same) - int(same.sum())
            if cut:
                yield links(table[:, :cut])
            held, size = [table[:, cut:]], table.shape[1] - cut
    if held:
        yield links(np.concatenate(held, axis=1))


def _bits(column, shift: int, width: int):
    return F.shiftrightunsigned(column, shift).bitwiseAND((1 << width) - 1)


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Links ``turn``, ``a``, ``b`` that connect all fingerprints (``turn``, ``fp``) of a round within the budget."""
    if budget >= BLOCKS:
        raise ValueError("the budget must be below the number of blocks")
    fp = F.col("fp")
    roots = []
    for block in range(BLOCKS):
        shift = block * BLOCK_BITS
        low = fp.bitwiseAND((1 << shift) - 1) if shift else F.lit(0).cast("bigint")
        high = F.shiftrightunsigned(fp, shift + BLOCK_BITS) if shift + BLOCK_BITS < 64 else F.lit(0).cast("bigint")
        key = _bits(fp, shift, BLOCK_BITS) + (block << BLOCK_BITS) + F.shiftleft(F.col("turn").cast("bigint"), _TURN)
        roots.append(F.struct(key.alias("top"), F.shiftleft(high, shift).bitwiseOR(low).alias("other")))
    rows = distinct.select("fp", F.explode(F.array(*roots)).alias("x")).select("fp", "x.top", "x.other")
    # At most BLOCKS x 2^BLOCK_BITS rows a round.
    split = rows.groupBy("top").count().where(F.col("count") > hot).select(F.col("top").alias("_top"))
    marked = rows.join(F.broadcast(split), F.col("top") == F.col("_top"), "left")
    other = F.col("other")
    subs = []
    for sub in range(SUB_BLOCKS):
        shift = sub * SUB_BITS
        low = other.bitwiseAND((1 << shift) - 1) if shift else F.lit(0).cast("bigint")
        above = 48 - shift - SUB_BITS
        high = F.shiftrightunsigned(other, shift + SUB_BITS) if above else F.lit(0).cast("bigint")
        inside = F.col("top").bitwiseAND((1 << _TURN) - 1)
        turn = F.col("top").bitwiseAND(-(1 << _TURN))
        key = turn + F.shiftleft(inside, SUB_BITS).bitwiseOR(_bits(other, shift, SUB_BITS)) + (sub << 32)
        rest = F.shiftleft(high, shift).bitwiseOR(low)
        subs.append(F.struct(F.lit(sub).cast("bigint").alias("sub"), key.alias("key"), rest.alias("rest")))
    whole = F.struct(F.lit(-1).cast("bigint").alias("sub"), F.col("top").alias("key"), other.alias("rest"))
    dealt = marked.select(
        "fp", F.explode(F.when(F.col("_top").isNull(), F.array(whole)).otherwise(F.array(*subs))).alias("x")
    ).select("x.sub", "x.key", "x.rest", "fp")
    ship_package(distinct.sparkSession)
    # Rests are below 2^63, so signed and unsigned orders agree.
    return (
        dealt.repartition("sub", "key")
        .sortWithinPartitions("sub", "key", "rest")
        .mapInArrow(lambda batches: _join_runs(batches, budget), "turn bigint, a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    budget: int = BUDGET,
    rounds: int = 1,
    key: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``fp`` (of the first round), ``component_id`` of every row (smallest doc_id reachable).

    ``key``, an expression of an orderable type, stands for doc_id if given.
    """
    prints = cut_lineage(fingerprints(docs, shingle, rounds, key))
    every = prints.select("doc_id", F.posexplode("fps").alias("turn", "fp"))
    first = cut_lineage(every.groupBy("turn", "fp").agg(F.min("doc_id").alias("first_id")))
    links = fingerprint_links(first.select("turn", "fp"), budget)
    ends = [F.struct(F.col("turn").cast("int").alias("turn"), F.col(x).alias("fp")).alias(x) for x in "ab"]
    roots = connected_components(links.select(*ends))
    members = first.join(roots.select("node.*", "root"), ["turn", "fp"], "left")
    least = members.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = members.join(least, "root", "left").select(
        "turn", "fp", F.coalesce("least_id", "first_id").alias("component_id")
    )
    placed = every.join(named, ["turn", "fp"])
    if rounds == 1:
        return placed.select("doc_id", "fp", "component_id")
    # A document and its component's first one are linked in every round; the union has its own components.
    joins = placed.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "component_id")
    united = connected_components(joins)
    return prints.join(united, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("fps")[0].alias("fp"), F.coalesce("root", "doc_id").alias("component_id")
    )


def drop_near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, rounds: int = 1
) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id.

    * Rows without a doc_id can't be named as a group's member and all stay.
    * Rows that repeat a doc_id are documents of their own where their texts
      differ: a component keeps the one with the smallest (doc_id, text hash).
      Rows that repeat both are one document, and the row of the smallest hash stays.
    * Columns of any name pass through unchanged.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    key = F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"))
    found = near_duplicates(named, shingle, budget, rounds, key)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not _holds_map(f.dataType)]
    rows = named.select(key.alias("key"), F.struct("*").alias("row"), F.xxhash64(*plain).alias("order"))
    single = rows.join(kept, "key").groupBy("key").agg(F.min_by("row", "order").alias("row"))
    return single.select("row.*").unionAll(docs.where(F.col("doc_id").isNull()))


def _holds_map(kind) -> bool:
    """Whether a type can't be hashed."""
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()
