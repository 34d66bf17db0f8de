"""Compare a registered query with its SQL on the same files."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    compare.seconds = time.time() - t0
    if sql is None:
        return None if got_cols else "no columns"
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        have, need = set(got), set(want)
        extra = [r for r in got if r not in need][:3]
        lost = [r for r in want if r not in have][:3]
        return f"{len(got)} rows != {len(want)} rows; only spark {extra}; only sql {lost}"
    return None


def main():
    from tallyloom.queries import ORACLE, QUERIES
    from tallyloom.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session("8")
    con = connect(sf_dir)
    bad = []
    for name in names:
        t0 = time.time()
        try:
            problem = compare(spark, con, sf_dir, QUERIES[name], ORACLE.get(name))
            rows = "ok" if problem is None else problem
        except Exception as e:  # noqa: BLE001
            problem = rows = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'  ' if problem is None else '! '}{name:28} {getattr(compare, 'seconds', 0):5.1f}s of {time.time() - t0:5.1f}s {'sql' if name in ORACLE else 'rows'} {rows}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
