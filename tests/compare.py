"""Run a query in Spark and its SQL in DuckDB on the same tables; say how they differ."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str, bytes)):
        return x
    return round(float(x), 6) + 0.0 if hasattr(x, "__float__") else x


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if both give the same rows in any order."""
    names = sorted(df.columns)
    got = sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = sorted((tuple(_cell(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if got == want:
        return ""
    bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"{len(got)} and {len(want)} rows; {names}: {bad}"
