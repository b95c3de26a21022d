"""Comparison of a query with its SQL."""

from __future__ import annotations

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def same(con: duckdb.DuckDBPyConnection, df, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
