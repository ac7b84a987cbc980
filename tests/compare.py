"""Rows of a Spark query against those of SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=repr)


def differences(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection, tolerance: float = 2e-6) -> list[str]:
    """What differs; numbers may differ by one unit of the digit that both sides are rounded to."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} and {len(theirs)} rows", *map(repr, ours[:3]), *map(repr, theirs[:3])]
    out = []
    for a, b in zip(ours, theirs, strict=True):
        same = all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and type(x) is type(y) and math.isclose(x, y, rel_tol=1e-9, abs_tol=tolerance) for x, y in zip(a, b, strict=True))
        if not same:
            out.append(f"{a} and {b}")
    return out[:5]
