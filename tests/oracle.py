"""Compares a query with its SQL, row for row in any order."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if glob.glob(p):
            src = f"{p}/*.parquet" if os.path.isdir(p) else p
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{src}')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, f, sql: str, sf_dir: str, con=None) -> str:
    """What differs, or nothing."""
    con = con or connect(sf_dir)
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(list(rel.columns), rel.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    a, b = set(got[1]), set(want[1])
    return f"{len(got[1])} and {len(want[1])} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
