"""Run the registered queries against their SQL and report differences.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, query, sql: str | None) -> tuple[str, float, int]:
    started = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return "rows only", took, len(rows)
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(columns)}", took, len(rows)
    ours, theirs = normal(rows, df.columns), normal(expected, columns)
    if ours != theirs:
        first = next((p for p in zip(ours, theirs) if p[0] != p[1]), None)
        return f"DIFFERENT rows {len(ours)}/{len(theirs)} first {first}", took, len(rows)
    return "equal", took, len(rows)


def main() -> int:
    import __spark_entry__ as entry
    from prorrata.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark, sql = local_session(), entry.oracle_sql()
    connection = oracle_connection(folder)
    bad = 0
    for name in chosen:
        try:
            verdict, took, count = compare(spark, connection, folder, entry.queries()[name], sql.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, took, count = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0.0, 0
        bad += verdict not in ("equal", "rows only")
        print(f"{name:34s} {took:7.2f}s {count:8d} rows  {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
