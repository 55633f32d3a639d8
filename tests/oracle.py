"""Runs a query and its SQL side by side."""

import decimal
import glob
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    for p in glob.glob(d + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6))
    return repr(v)


def same(df, con, sql):
    rows, cols = df.collect(), df.columns
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(names)
    a = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    b = sorted(tuple(norm(r[names.index(c)]) for c in sorted(cols)) for r in want)
    assert a == b
    return len(a)
