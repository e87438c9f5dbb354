"""Compare registered queries with their SQL oracle: python tests/oracle_check.py [sf] [prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(directory: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from '{directory}/{name}.parquet'")
    return connection


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, connection, directory: str, run, sql: str):
    """None if equal, else a message."""
    df = run(spark, directory)
    left = normalized(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]).upper() for d in cursor.description}
    right = normalized(names, cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    spark_kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "int": "INTEGER"}
    for name, kind in df.dtypes:
        if spark_kinds.get(kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    differing = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if differing:
        return f"DIFF {len(differing)} of {len(left[1])} rows differ, e.g.\n  {differing[0][0]}\n  {differing[0][1]}"
    if not left[1]:
        print("  note: no rows", flush=True)
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    directory = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = local_session()
    connection = connect(directory)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracle:
                message = compare(spark, connection, directory, queries[name], oracle[name])
            else:
                message = None
                count = queries[name](spark, directory).count()
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        note = "ok" if name in oracle else "rows only"
        print(f"{'FAIL' if message else note:9} {took:6.2f}s {name} {message or ''}", flush=True)
        bad += bool(message)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
