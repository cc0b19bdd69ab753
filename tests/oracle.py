"""Runs registered queries against their DuckDB SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def compare(spark, sf_dir: str, f, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = f(spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} {sorted(rel.columns)}"
    mine = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(norm(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    if mine != theirs:
        extra, gone = sorted(set(mine) - set(theirs), key=repr)[:2], sorted(set(theirs) - set(mine), key=repr)[:2]
        return f"{len(mine)} rows, {len(theirs)} expected; {extra} against {gone}"
    return ""
