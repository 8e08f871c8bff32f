"""Runs a query and its SQL side by side."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(sf_dir=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def compare(spark, con, build, sql, sf_dir=DATA):
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    a, b = sorted(range(len(cols)), key=lambda i: df.columns[i]), sorted(range(len(cols)), key=lambda i: cols[i])
    assert sorted(tuple(_norm(r[i]) for i in a) for r in got) == sorted(tuple(_norm(r[i]) for i in b) for r in want)
