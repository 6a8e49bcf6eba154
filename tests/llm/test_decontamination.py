"""Suffix arrays: the contract by brute force, longest matches, pieces and blocks."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest_llm import load, load_items

from lodestar.llm import queries, suffix_arrays

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def by_hand(texts, items, window=10):
    windows: dict[tuple, set] = {}
    for name, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("null" if name is None else str(name))
    lengths = {len(w) for w in windows}
    out = []
    for d, text in texts:
        words, hit, found = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (own := windows.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(words), len(hit), len(found), ",".join(sorted(found))))
    return out


@pytest.mark.parametrize("name", ["odd", "real"])
def test_contract(spark, request, name):
    folder = request.getfixturevalue(name)
    want = [
        (d, n, hit, items, hashlib.sha256(names.encode()).hexdigest(), hit > 0)
        for d, n, hit, items, names in by_hand(load(folder), load_items(folder))
    ]
    found = queries.op11_suffix_arrays(spark, folder).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[5] for r in got)


def test_blocks_give_what_one_block_gives(spark, odd):
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    one = suffix_arrays.contamination(docs, items).collect()
    many = suffix_arrays.contamination(docs, items, size=60).collect()
    assert sorted(one, key=repr) == sorted(many, key=repr)
    kept = suffix_arrays.remove_contaminated(docs, items, size=60)
    assert kept.columns == docs.columns
    clean = sorted((r.doc_id for r in one if not r.spans), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == clean


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (500, 0, 30, 300, 1)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate((12, 11, 3, 40, 10, 1))]
    items.append((9, texts[0][100:180]))
    block = suffix_arrays.item_block([(str(i), t.encode()) for i, t in items])
    want = by_hand(list(enumerate(texts)), items)
    for piece in (7, 50, 1000):
        monkeypatch.setattr(suffix_arrays, "PIECE", piece)
        monkeypatch.setattr(suffix_arrays, "SLICE", 64)
        rows = suffix_arrays.judge([t.encode() for t in texts], block)
        got = [(i, r.n_words, sum(b - a for a, b in r.spans), len(r.items), ",".join(sorted(r.items))) for i, r in enumerate(rows)]
        assert got == want, piece


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (50, 2), (400, 3), (300, 200), (1000, 2)):
        data = rng.integers(1, top + 1, n)
        data = np.r_[data[: n // 2], data[: n // 2], data, 0].astype(np.int64)
        data[-1] = 0
        order = suffix_arrays.suffix_array(data, top + 1).tolist()
        assert order == sorted(range(len(data)), key=lambda i: data[i:].tolist())


def test_longest_matches(spark):
    docs = spark.createDataFrame(
        [(5, "x a b c d e y"), (3, "z a b c d"), (4, "b c d e f g"), (None, "a b c d e"), (6, None)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([("i", "a b c d e f"), ("j", "q r s"), ("k", "f g")], "item_id string, text string")
    found = suffix_arrays.longest_matches(docs, items, window=3).collect()
    got = {(r.item, r.offset): (r.length, r.doc_id, r["first"]) for r in found}
    assert got == {("i", 0): (5, 5, 1), ("i", 1): (5, 4, 0), ("i", 2): (4, 4, 1), ("i", 3): (3, 4, 2), ("k", 0): (2, 4, 4)}


def test_no_items_and_clashing_columns(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet").selectExpr("*", "1 AS n_words", "2 AS spans", "3 AS row")
    none = spark.read.parquet(f"{empty}/benchmark.parquet")
    assert not any(r.spans or r["items"] for r in suffix_arrays.contamination(docs, none).collect())
    assert suffix_arrays.remove_contaminated(docs, none).count() == docs.count()
    assert suffix_arrays.longest_matches(docs, none).collect() == []
    items = spark.read.parquet(f"{odd}/benchmark.parquet").selectExpr("*", "1 AS k", "2 AS t")
    kept = suffix_arrays.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
