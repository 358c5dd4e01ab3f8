"""Comparison of a Spark result with what DuckDB gives on the same files."""

import math
import os
from pathlib import Path

import duckdb

ROOT = str(Path(__file__).resolve().parent.parent)
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x.isoformat()[:26] if hasattr(x, "isoformat") else x


def rows_of(columns, rows):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in place) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def assert_same(df, sql, con):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(columns)
    assert got == want
