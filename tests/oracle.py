"""Runs registered queries on Spark and DuckDB over the same files and compares the rows.

Command line: ``python -m tests.oracle SF_DIR [name or prefix* ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from boxledger.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, sf_dir, fn, sql):
    """(ok, message)"""
    t0 = time.time()
    cols, got = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    n = sum(got.values())
    if sql is None:
        return n > 0, f"rows only: {n} rows, spark {t1 - t0:.1f}s"
    cols2, want = duck_rows(con, sql)
    t2 = time.time()
    note = f"{n} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if cols != cols2:
        return False, f"columns {cols} != {cols2}"
    if got != want:
        more, less = got - want, want - got
        return False, f"{note}; want {sum(want.values())} rows; spark only {list(more.items())[:3]}; duck only {list(less.items())[:3]} {cols}"
    return True, note


if __name__ == "__main__":
    from boxledger.catalog import ORACLES, QUERIES
    from boxledger.session import local_session

    spark = local_session()
    sf = sys.argv[1]
    con = connect(sf)
    picks = sys.argv[2:]
    bad = 0
    for name, fn in QUERIES.items():
        if picks and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in picks):
            continue
        try:
            ok, msg = compare(spark, con, sf, fn, ORACLES.get(name))
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok " if ok else "BAD", name, msg, flush=True)
    print("failed:", bad)
