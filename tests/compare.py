"""Rows of a query against rows of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else round(v, 9))
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def difference(df, con, sql: str) -> str:
    """Empty if the rows agree."""
    r = con.sql(sql)
    names = r.columns
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    key = lambda row: repr(row)
    a = sorted((tuple(plain(x[c]) for c in sorted(names)) for x in df.collect()), key=key)
    at = [names.index(c) for c in sorted(names)]
    b = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=key)
    if a == b:
        kinds = {c: str(t) for c, t in zip(names, r.types)}
        odd = {c: (t, kinds[c]) for c, t in df.dtypes if (t, kinds[c]) in {("bigint", "HUGEINT"), ("bigint", "INTEGER"), ("int", "BIGINT"), ("double", "DECIMAL")} or (t == "double" and kinds[c].startswith("DECIMAL"))}
        return f"types {odd}" if odd else ""
    only = lambda x, y: [r for r in x if r not in set(y)][:3]
    return f"{len(a)} rows against {len(b)}; only here {only(a, b)}; only in SQL {only(b, a)}"
