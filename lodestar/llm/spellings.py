"""Spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. Bigrams have one global order, rare ones first. A word's prefix
is its first three bigrams (by gram, then place) and up to two more if they are
the same gram as the third; its two pivots are the disjoint pair of the first
three with the least summed frequency, found by dynamic programming.

One edit can't touch both pivots. Of two near words let s be the one whose third
gram is not after the other's: the pivot that the edit leaves alone is then in
the other's prefix. It takes its third gram at most as far back as two grams that
were before it and the two that an edit adds, hence the two places more.

Position limits: with p before q the pivots, an edit behind p leaves all up to
the end of p alone; any other edit leaves all from q on alone. So one side of
the shared pivot is equal, and its text is the key under which pivots meet
prefixes. Where that side is shorter than half the word, the other side is
halved: the edit is in one half, and the other half belongs to the key too.
Pairs that meet are verified by edit distance.

Words and keys are counted, joined and verified by Spark; a key is a 64-bit hash,
so that no text travels but the words.

A word's form is its near word with the most occurrences, if those are RATIO
times its own at least; its root is what the forms lead to.

* A null or empty text has no words. Rows that repeat a doc_id are read each.
* A null doc_id is an empty name in the hash that decides deletions.
* Ties of occurrences: the smallest word in code-point order is the form.
* Words of any length are compared whole.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import cut_lineage, ship_package

#: Fewest code points and occurrences of a word, and how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: A run whose hash this divides loses a code point.
DELETE_EVERY = 31
#: Distinct words that a task holds before it passes on their counts.
HELD = 400_000
#: Grams of a word, edits, and how many grams are its prefix and how many ties follow.
GRAM, EDITS = 2, 1
PREFIX, TIES = GRAM * EDITS + 1, GRAM * EDITS

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs_of(doc_id: int | None, text: bytes, every: int = DELETE_EVERY) -> list[bytes]:
    """Lower-cased runs of letters of a text, some of them without one of their code points."""
    runs = _RUN.findall(text.lower())
    name = b"" if doc_id is None else b"%d" % doc_id
    start, crc = zlib.crc32(name + b":"), zlib.crc32
    hashes = np.fromiter((crc(run, start) for run in runs), np.int64, len(runs))
    for i in np.flatnonzero(hashes % every == 0).tolist():
        run = runs[i].decode()
        at = int(hashes[i]) % len(run)
        runs[i] = (run[:at] + run[at + 1 :]).encode()
    return runs


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DELETE_EVERY
) -> DataFrame:
    """``word``, ``n`` of all words that are long and frequent enough."""
    ship_package(docs.sparkSession)

    def batch(counts: Counter) -> pa.RecordBatch:
        # Two bytes a code point at most, so shorter words are left out early.
        words = [w for w in counts if len(w) >= least_length and len(w.decode()) >= least_length]
        arrays = [pa.array([w.decode() for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                counts.update(runs_of(doc_id, (text or "").encode(), every))
                if len(counts) >= HELD:
                    yield batch(counts)
                    counts.clear()
        yield batch(counts)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> dict[str, int]:
    """How many times each bigram stands in the words; at most the square of the alphabet (90 letters)."""
    places = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substr(F.col("word"), i, F.lit(GRAM)))).alias("g"))
    return {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}


def pivots(grams: list[tuple[int, str, int]], k: int = EDITS + 1) -> list[int]:
    """Places of ``k`` grams that don't overlap and are rarest in sum.

    ``grams`` are (frequency, gram, place). Going through the places in order,
    the best choice of j grams up to a gram either leaves it or takes it after the
    best choice of j - 1 grams that end before it.
    """
    by_place = sorted((place, n) for n, _, place in grams)
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * k]
    for i, (place, n) in enumerate(by_place):
        before = i
        while before and by_place[before - 1][0] > place - GRAM:
            before -= 1
        row = list(best[i])
        for j in range(1, k + 1):
            if (last := best[before][j - 1]) is not None:
                taken = (last[0] + n, (*last[1], place))
                if row[j] is None or taken < row[j]:
                    row[j] = taken
        best.append(row)
    return list(best[-1][k][1])


def _left_keys(word: str, p: int, n: int) -> list[str]:
    """Keys of an edit behind the gram at ``p`` for a pivot's word of length ``n``; ``word`` is it or its partner."""
    end = p + GRAM
    if 2 * end >= n:
        return ["<" + word[:end]]
    half = (n - end) // 2
    tail = n - end - half
    return ["<" + word[: end + half], f"{word[:end]}|{word[len(word) - tail:]}"]


def _right_keys(word: str, q: int, n: int) -> list[str]:
    """Keys of an edit before the last ``q`` letters, which start with the gram."""
    if 2 * q >= n:
        return [">" + word[len(word) - q :]]
    half = (n - q) // 2
    return [">" + word[len(word) - (n - half) :], f"{word[:half]}|{word[len(word) - q:]}"]


def keys_of(word: str, order: dict[str, int]) -> tuple[set[str], set[str]]:
    """Keys of the word's pivots, and keys under which pivots of near words find its prefix."""
    n = len(word)
    grams = [(order[word[i : i + GRAM]], word[i : i + GRAM], i) for i in range(n - GRAM + 1)]
    # Ties beyond the prefix and the grams before it.
    first = heapq.nsmallest(PREFIX + TIES, grams)
    prefix = first[:PREFIX] + [g for g in first[PREFIX:] if g[:2] == first[PREFIX - 1][:2]]
    p, q = pivots(first[:PREFIX])
    own = {*_left_keys(word, p, n), *_right_keys(word, n - q, n)}
    found = set()
    for _, _, place in prefix:
        for m in (n - 1, n, n + 1):
            if place + GRAM <= m:
                found.update(_left_keys(word, place, m))
            if n - place <= m:
                found.update(_right_keys(word, n - place, m))
    return own, found


def key_table(words: DataFrame) -> DataFrame:
    """``key``, ``word``, ``n``, ``pivot``: the keys of every word as a pivot's owner and as a prefix's."""
    ship_package(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast(gram_order(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, digest = shared.value, xxhash.xxh64_intdigest
        for batch in batches:
            keys, at, sides = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                for side, texts in zip((True, False), keys_of(word, order)):
                    keys.extend([digest(t) for t in texts])
                    at.extend([i] * len(texts))
                    sides.extend([side] * len(texts))
            rows = batch.take(pa.array(at, pa.int64()))
            hashed = pa.array(np.array(keys, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [hashed, rows.column("word"), rows.column("n"), pa.array(sides, pa.bool_())],
                names=["key", "word", "n", "pivot"],
            )

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint, pivot boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n_a``, ``n_b``: every pair of near words once, a before b."""
    table = cut_lineage(key_table(words))
    own = table.where("pivot").select("key", F.col("word").alias("x"), F.col("n").alias("n_x"))
    other = table.where("NOT pivot").select("key", F.col("word").alias("y"), F.col("n").alias("n_y"))
    met = own.join(other, "key").where(
        (F.abs(F.length("x") - F.length("y")) <= EDITS)
        & (F.col("x") != F.col("y"))
        & (F.levenshtein("x", "y", EDITS) == EDITS)
    )
    first = F.col("x") < F.col("y")
    return met.select(
        F.least("x", "y").alias("a"),
        F.greatest("x", "y").alias("b"),
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
        F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"),
    ).distinct()


def followed(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of every word that has a form (``word``, ``form``).

    A form is RATIO times as frequent, so chains are short; each round doubles
    the part of a chain that is followed.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        roots = cut_lineage(roots)
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = roots.join(ahead, F.col("root") == F.col("at"), "left")
        if not joined.where(F.col("next").isNotNull()).limit(1).count():
            return roots
        roots = joined.select("word", F.coalesce("next", "root").alias("root"))


def spelling_report(docs: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word."""
    words = cut_lineage(word_counts(docs, **options))
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    near = (
        pairs.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("falling"), F.col("near").alias("near"))).alias("top"),
        )
    )
    enough = -F.col("top.falling") >= F.lit(ratio) * F.col("n")
    report = cut_lineage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(enough, F.col("top.near")).alias("form"),
            F.when(enough, -F.col("top.falling")).alias("form_n"),
        )
    )
    roots = followed(report.where(F.col("form").isNotNull()))
    return report.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def normalized_spelling(docs: DataFrame, report: DataFrame, column: str = "spellings") -> DataFrame:
    """``doc_id`` and ``spellings``: the words of each text that have another root, with it."""
    changed = report.where(F.col("root") != F.col("word")).select("word", "root")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_distinct(runs).alias("runs"))
    slim = cut_lineage(slim)
    hits = slim.select("row", F.explode("runs").alias("word")).join(changed, "word")
    maps = hits.groupBy("row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "root")))).alias(column))
    return slim.select("row", "doc_id").join(maps, "row", "left").select("doc_id", column)
