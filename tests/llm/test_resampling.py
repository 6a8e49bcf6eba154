"""Resampling: the contract by brute force, composed checksums, odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import load, load_items
from test_decontamination import words_of

from lodestar.llm import queries, resampling


def by_hand(texts, target, longest=1, buckets=10_000, least=20, percent=10):
    def own(text):
        words = words_of(text)
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    rows = [(d, *own(t)) for d, t in texts]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for _, x in target for b in own(x)[1])
    size, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in s}
    scored = []
    for d, n, found in rows:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((d, len(found), weight, weight + noise, n))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return out + [(*r[:4], None) for r in scored if r[4] < least]


@pytest.mark.parametrize("name", ["odd", "real"])
def test_contract(spark, request, name):
    folder = request.getfixturevalue(name)
    found = queries.op12_importance_draw(spark, folder).collect()
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found]
    assert sorted(got, key=repr) == sorted(by_hand(load(folder), load_items(folder)), key=repr)


@pytest.mark.parametrize("longest,buckets", [(3, 100_000), (2, 50)])
def test_longer_runs(spark, odd, longest, buckets):
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    found = resampling.resampling_report(docs, items, longest=longest, buckets=buckets, percent=50).collect()
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found]
    assert sorted(got, key=repr) == sorted(by_hand(load(odd), load_items(odd), longest, buckets, percent=50), key=repr)


def test_composed_checksums_are_those_of_joined_words():
    rng = np.random.default_rng(4)
    for _ in range(30):
        words = [rng.integers(48, 256, rng.integers(1, 300), dtype=np.uint8).tobytes() for _ in range(rng.integers(1, 9))]
        payloads = np.array([len(w) << 32 | zlib.crc32(w) for w in words])
        want = [zlib.crc32(b" ".join(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1)]
        assert resampling.run_crcs(payloads, 4).tolist() == want


def test_scan_tells_words_inside_words_apart():
    texts = [b"a ab abc b bc", b"", b"c a", b"...", b"ABC,abc"]
    found = list(resampling.features(texts, 1, 1 << 20))
    want = [[zlib.crc32(w.encode()) % (1 << 20) for w in words_of(t.decode())] for t in texts]
    assert [b.tolist() for _, b in found] == want


def test_drawn_documents_keep_their_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").selectExpr("*", "1 AS key", "2 AS row", "3 AS rank", "4 AS text_hash")
    items = spark.read.parquet(f"{odd}/benchmark.parquet")
    drawn = resampling.draw_documents(docs, items, percent=50)
    assert drawn.columns == docs.columns
    ranks = resampling.resampling_report(docs, items, percent=50).where("rank IS NOT NULL").collect()
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in ranks)


def test_no_target(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    found = resampling.resampling_report(docs, spark.read.parquet(f"{empty}/benchmark.parquet")).collect()
    assert sorted((r.doc_id, r.weight) for r in found if r.doc_id is not None) == sorted(
        (d, w) for d, _, w, *_ in by_hand(load(odd), []) if d is not None
    )
