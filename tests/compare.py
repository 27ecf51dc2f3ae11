"""Run registered queries next to their SQL statements and compare whole results.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return "decimal " + str(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(" ")
    return "NULL" if value is None else str(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None if both sides hold the same rows, otherwise what differs first."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = canonical(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return None
    extra, missing = sorted(set(got) - set(expected))[:2], sorted(set(expected) - set(got))[:2]
    return f"{len(got)} rows instead of {len(expected)}; columns {sorted(names)}; extra {extra}; missing {missing}"


def main() -> int:
    from zealmark.plans import oracles, registry
    from zealmark.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, statements = connect(sf_dir), oracles.oracle_sql()
    names = sys.argv[2:] or list(registry.queries())
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = registry.queries()[name](spark, sf_dir)
            if name in statements:
                problem = difference(df, con, statements[name])
                rows = con.execute(f"select count(*) from ({statements[name]})").fetchall()[0][0]
            else:
                problem, rows = None, f"{df.count()} (no SQL)"
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", "-"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {rows!s:>8s} {time.time() - began:6.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
