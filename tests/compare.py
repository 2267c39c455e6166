"""Runs queries against their SQL and reports the names that differ."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = os.environ.get("TALLOW_SF", "/root/testdata/sf0.001")


def connection(sf: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    try:
        return round(float(v), 6) + 0.0 if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def difference(spark, con, query, sql: str, sf: str = SF) -> str:
    df = query(spark, sf)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; {mine[:2]} {theirs[:2]}"
    off = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(off)} rows differ, such as {off[:2]}" if off else ""
