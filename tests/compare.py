"""Run registered queries and their SQL on the same tables and compare all rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(frame, con, sql: str) -> str:
    """Empty text if both give the same columns and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    want = _rows(names, result.fetchall())
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main(folder: str, only: list[str]) -> int:
    from tallywright.plans.oracle import oracle_queries
    from tallywright.plans.registry import all_queries
    from tallywright.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(folder), all_queries(), oracle_queries()
    print("without SQL:", sorted(queries.keys() - oracles.keys()),
          "without query:", sorted(oracles.keys() - queries.keys()))
    failed = 0
    for name in only or queries:
        began = time.time()
        try:
            wrong = differences(queries[name](spark, folder), con, oracles[name])
        except Exception as error:  # shown per query, the others go on
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(wrong)
        rows = con.execute(f"SELECT count(*) FROM ({oracles[name]}) q").fetchall()[0][0]
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - began:.2f}s {rows} rows {wrong}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(bool(main(args[0] if args else "/root/testdata/sf0.01", args[1:])))
