"""Comparison of a query with its SQL twin on the same Parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns: list[str], values) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


def differs(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows(df.columns, df.collect()), rows(names, result.fetchall())
    if ours != theirs:
        return f"{len(ours)} and {len(theirs)} rows, such as {[x for x in ours if x not in theirs][:2]} and {[x for x in theirs if x not in ours][:2]}"
    return None
