"""Pivotal grams: the contract by brute force, the lemma on dense alphabets, odd tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import load

from lodestar.llm import queries, spellings

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(texts):
    counts = Counter()
    for d, text in texts:
        for run in RUN.findall(text):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    rests: dict[str, set] = {}
    for w in words:
        for i in range(len(w)):
            rests.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out, forms = {}, {}
    for w, n in words.items():
        met = set().union(rests.get(w, set()), *(rests[w[:i] + w[i + 1 :]] for i in range(len(w))))
        met |= {w[:i] + w[i + 1 :] for i in range(len(w))} & set(words)
        close = [v for v in met if near(v, w)]
        top = min(close, key=lambda v: (-words[v], v), default=None)
        if top is not None and words[top] >= 10 * n:
            forms[w] = top
        out[w] = (n, len(close))
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        rows.append((w, form, root, n, n_near, words[form] if form else None))
    return rows


@pytest.mark.parametrize("name", ["odd", "real"])
def test_contract(spark, request, name):
    folder = request.getfixturevalue(name)
    check(spark, folder, load(folder))


def check(spark, folder, texts):
    found = queries.op13_pivotal_grams(spark, folder).collect()
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found]
    want = by_hand(texts)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def test_chains_of_forms(spark, tmp_path):
    from conftest_llm import document_table, write_tables

    long = "ab" * 4000
    words = {"bananas": 3000, "bananes": 250, "bananés": 20, "cananés": 2, "kananés": 2, "Àÿ×÷ana": 3, long: 2, long + "a": 25}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())] + [(None, "bananas bananes"), (9, None)]
    folder = write_tables(tmp_path / "t", document_table(rows))
    want = {r[0]: r for r in check(spark, folder, [(d, t or "") for d, t in rows])}
    assert len(want) >= 5


@pytest.mark.parametrize("alphabet,longest", [("a", 40), ("ab", 10), ("abc", 8), ("abé", 13)])
def test_no_near_pair_is_missed(alphabet, longest):
    rng = random.Random(7)
    words = set()
    for _ in range(200):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, longest)))
        k, c = rng.randrange(len(w)), rng.choice(alphabet)
        words |= {v for v in (w, w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]) if len(v) >= 7}
    order = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    keys = {w: spellings.keys_of(w, order) for w in words}
    for a in words:
        for b in words:
            if a < b and near(a, b):
                assert keys[a][0] & keys[b][1] or keys[b][0] & keys[a][1], (a, b)


def test_pivots_are_the_rarest_disjoint_grams():
    rng = random.Random(8)
    for _ in range(300):
        grams = [(rng.randint(1, 9), "xx", p) for p in rng.sample(range(9), rng.randint(3, 6))]
        pairs = [(a[0] + b[0], *sorted((a[2], b[2]))) for a in grams for b in grams if a[2] + 2 <= b[2]]
        found = spellings.pivots(grams)
        freq = {p: n for n, _, p in grams}
        assert found[1] - found[0] >= 2 and sum(freq[p] for p in found) == min(pairs)[0]


def test_spellings_of_documents(spark):
    docs = spark.createDataFrame([(1, "Bananes bananas x"), (2, None), (None, "bananes")], "doc_id long, text string")
    report = spark.createDataFrame([("bananes", "bananas"), ("bananas", "bananas")], "word string, root string")
    found = {r.doc_id: r.spellings for r in spellings.normalized_spelling(docs, report).collect()}
    assert found == {1: {"bananes": "bananas"}, 2: None, None: {"bananes": "bananas"}}
