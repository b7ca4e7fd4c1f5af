"""Run queries beside their SQL and compare: ``python compare.py [--sf 0.01] [name part ...]``."""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from cohortframe.session import local_session

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(df, con, sql) -> str | None:
    """What differs between a Spark result and the SQL result, or None."""
    got = [tuple(row) for row in df.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    from driver_queries import ORACLES, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("parts", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(folder)
    failed = 0
    for name, build in QUERIES.items():
        if args.parts and not any(p in name for p in args.parts):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
                note = "same" if problem is None else problem
            else:
                problem, note = None, f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = note = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
