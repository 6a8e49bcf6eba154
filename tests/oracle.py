"""Run registered queries against their DuckDB twins.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is None, str(value)) for value in row)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    result = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in result.description}
    duck_names = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    problems = []
    names = sorted(df.columns)
    if names != sorted(duck_names):
        return [f"columns {names} != {sorted(duck_names)}"]
    for name, kind in df.dtypes:
        if TYPE_NAMES.get(kind, kind) != duck_types[name]:
            problems.append(f"type of {name}: {kind} != {duck_types[name]}")
    spark_rows = [tuple(row[n] for n in names) for row in df.collect()]
    order = [duck_names.index(n) for n in names]
    duck_rows = [tuple(row[i] for i in order) for row in duck_rows]
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    left = sorted(spark_rows, key=_key)
    right = sorted(duck_rows, key=_key)
    different = [(a, b) for a, b in zip(left, right) if not _same(a, b)]
    if different:
        problems.append(f"{len(different)} rows differ, first {names}: {different[0]}")
    if not left:
        problems.append("empty result")
    return problems


def _same(a: tuple, b: tuple) -> bool:
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, float):
            if repr(x) != repr(y) and not (math.isnan(x) and math.isnan(y)):
                return False
        elif x != y:
            return False
    return True


def main(argv: list[str]) -> None:
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    folder = "/root/testdata/sf0.01"
    names = argv
    if argv and argv[0].startswith("/"):
        folder, names = argv[0], argv[1:]
    spark = make_session()
    con = connect(folder)
    oracles = oracle_sql()
    bad = 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                problems = [] if df.count() else ["empty result"]
        except Exception as error:  # noqa: BLE001 - report every query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        kind = "oracle" if name in oracles else "rows"
        status = "ok  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {name} [{kind}] {time.time() - start:.1f}s", *problems, sep="\n    " if problems else " ", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
