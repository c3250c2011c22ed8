"""Comparison of a query with its DuckDB SQL, as the driver does it: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if (path := Path(folder, f"{t}.parquet")).exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "item"):
        value = value.item()
    return f"{value:.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def difference(df, sql: str, folder: str) -> str:
    """Empty if both give the same columns and rows."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = connect(folder).execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return ""
