"""Brute-force twins of the contracts, and small tables with every odd case."""

import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PROSE = "one morning the river rose over the old stone bridge and nobody in the village saw it happen again"


def odd_texts() -> list[tuple[int | None, str | None]]:
    passage = " ".join(f"shared{i}" for i in range(30))
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    rows = [
        (0, None),
        (1, ""),
        (2, " \t\n\r "),
        (3, "a"),
        (4, "A b"),
        (5, PROSE),
        (6, PROSE.upper()),
        (7, PROSE),
        (8, passage + " then " + PROSE),
        (9, PROSE + " and " + passage),
        (10, "x " * 200),
        (11, long),
        (12, long + " tail"),
        (13, "mail a.b@c-d.example.org or 10.0.0.255 or 256.1.1.1, +1 (555) 555-1234, 4111 1111 1111 1111 and 4111111111111112"),
        (14, "日本語のテキスト 😀 é\x1cz\x85q\xa0w ½ ²"),
        (15, "line\nline\n\nline\n  \nother"),
        (16, "####" * 300 + " " + "*" * 2000),
        (17, "a" * 3000 + "@" * 50 + "b" * 3000),
        (18, "  lead and trail  \n\n  x\t\ty "),
        (19, "aaaa aaaa aaaa 'll don't’s <|endoftext|>"),
        (20, passage),
        (20, passage),
        (None, "no id " + passage),
    ]
    for i in range(21, 29):
        rows.append((i, f"menu home about\nbody of page {i} " + " ".join(f"b{i}w{j}" for j in range(60))))
    return rows


def document_table(rows=None) -> pa.Table:
    rows = odd_texts() if rows is None else rows
    n = len(rows)
    return pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text": pa.array([r[1] for r in rows], pa.string()),
            "lang": pa.array([None, *["en"] * (n - 1)][:n], pa.string()),
            "source": pa.array([None if i % 7 == 0 else "site" for i in range(n)], pa.string()),
            "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64()),
            # Names that operators use for their own columns.
            "kept": pa.array(["mine"] * n, pa.string()),
            "shard": pa.array([1.5] * n, pa.float64()),
            "ids": pa.array([[1]] * n, pa.list_(pa.int64())),
            "slice": pa.array(range(n), pa.int64()),
            "hash": pa.array(range(n), pa.int64()),
        }
    )


def write_tables(folder, docs: pa.Table, labels=(), pages=(), items=()) -> str:
    os.makedirs(folder, exist_ok=True)
    pq.write_table(docs, f"{folder}/documents.parquet")
    columns = list(zip(*labels)) or [(), (), ()]
    types = [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]
    pq.write_table(pa.table({n: pa.array(c, t) for (n, t), c in zip(types, columns)}), f"{folder}/labels.parquet")
    columns = list(zip(*pages)) or [(), (), ()]
    types = [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]
    pq.write_table(pa.table({n: pa.array(c, t) for (n, t), c in zip(types, columns)}), f"{folder}/pages.parquet")
    columns = list(zip(*items)) or [(), ()]
    types = [("item_id", pa.int64()), ("text", pa.string())]
    pq.write_table(pa.table({n: pa.array(c, t) for (n, t), c in zip(types, columns)}), f"{folder}/benchmark.parquet")
    return str(folder)


ITEMS = [
    (1, PROSE),
    (2, "The Bridge; nobody"),
    (10, "shared3 shared4 shared5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13 unseen"),
    (3, None),
    (4, "... !"),
    (5, "w977 never stood anywhere in these texts at all or so one hopes"),
    (6, "日本語のテキスト"),
    (2, "body of page 25"),
    (7, PROSE.upper() + " and then more"),
    (None, "b21w3 b21w4"),
]


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    labels = [(5, 1, 0), (8, 1, 0), (10, 0, 0), (16, 0, 0), (99, 1, 1), (None, 1, 0), (3, None, None)]
    pages = [(1, "http://a", "<p>x<p>y"), (2, None, None), (3, "http://b", ""), (None, "u", "<table><tr><td>a<td>b")]
    return write_tables(tmp_path_factory.mktemp("odd") / "t", document_table(), labels, pages, ITEMS)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty") / "t", document_table()[:0])


@pytest.fixture(scope="session")
def real(tmp_path_factory):
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"


def load(folder: str) -> list[tuple[int | None, str]]:
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    return [(d, t or "") for d, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist())]


def load_items(folder: str) -> list[tuple[int | None, str]]:
    table = pq.read_table(f"{folder}/benchmark.parquet", columns=["item_id", "text"])
    return [(d, t or "") for d, t in zip(table["item_id"].to_pylist(), table["text"].to_pylist())]
