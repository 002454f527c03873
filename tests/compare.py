"""A query's rows against its SQL in DuckDB, as multisets of normalised values."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def differences(spark, query, sql: str, folder: str = FOLDER) -> list:
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    found = connect(folder).execute(sql)
    theirs_names = [d[0] for d in found.description]
    if sorted(theirs_names) != names:
        return [("columns", names, theirs_names)]
    theirs = Counter(tuple(plain(r[theirs_names.index(n)]) for n in names) for r in found.fetchall())
    return list((mine - theirs).items())[:3] + list((theirs - mine).items())[:3]
