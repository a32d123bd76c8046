"""The comparison with DuckDB: row count, columns, and values regardless of order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        own = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{own}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return str(int(v)) if isinstance(v, bool) else None if v is None else str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """What differs; empty if nothing does."""
    got = con.execute(sql)
    columns, want = [c[0] for c in got.description], got.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    mine, other = rows_of(df.columns, df.collect()), rows_of(columns, want)
    if len(mine) != len(other):
        return f"{len(mine)} rows against {len(other)}"
    odd = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    return f"{len(odd)} rows differ, such as {odd[0]}" if odd else ""
