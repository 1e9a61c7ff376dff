"""Compare a query's rows with DuckDB's over the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("RESIDUA_TEST_DATA", "/root/testdata/sf0.01")


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns and rows agree, else what differs first."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    wanted = found.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)}, wanted {sorted(names)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    key = lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    mine = sorted((tuple(plain(v) for v in r) for r in frame.select(*order).collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in wanted), key=key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows, wanted {len(theirs)}"
    return next((f"{order}: {a}, wanted {b}" for a, b in zip(mine, theirs, strict=True) if a != b), None)
