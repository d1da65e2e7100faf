"""Compares a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def connection(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def assert_same(df, sql, con):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall())
    have = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    assert have == want
