"""Compares a Spark result with DuckDB's for the same query."""

from __future__ import annotations

import datetime as dt
import decimal
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else str(path)
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _kind(v) -> str:
    return "none" if v is None else type(_plain(v)).__name__


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs: columns, kinds of values, number of rows, rows."""
    out = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(out.columns):
        return [f"columns {names} {sorted(out.columns)}"]
    left = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    at = [out.columns.index(c) for c in names]
    right = [tuple(_plain(r[i]) for i in at) for r in out.fetchall()]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    left.sort(key=key), right.sort(key=key)
    found = []
    if len(left) != len(right):
        found.append(f"rows {len(left)} {len(right)}")
    kinds = [{_kind(r[i]) for r in side} - {"none"} for i in range(len(names)) for side in (left, right)]
    for i, c in enumerate(names):
        if kinds[2 * i] and kinds[2 * i + 1] and kinds[2 * i] != kinds[2 * i + 1]:
            found.append(f"kind of {c}: {kinds[2 * i]} {kinds[2 * i + 1]}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, first {bad[:2]}")
    return found
