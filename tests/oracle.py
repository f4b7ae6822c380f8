"""Rows of a Spark query against rows of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, float):
        return float(f"{v:.9e}")
    return v


def sql_rows(sql: str, d: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def compare(df, sql: str, d: str) -> str:
    """Empty if equal, else what differs."""
    cols, want = sql_rows(sql, d)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    order = sorted(cols)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in want), key=key)
    if a == b:
        return ""
    bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{len(a)} rows against {len(b)}; {bad}"
