"""Compare registered queries with their SQL on one scale factor: columns by name, rows as a multiset."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v if isinstance(v, (bool, str, bytes, type(None))) else float(v) if not isinstance(v, int) else v


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if both sides agree, else what differs."""
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    want, have = rows(names, cur.fetchall()), rows(got.columns, got.collect())
    if want == have:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only here {list((have - want).items())[:3]}; only in SQL {list((want - have).items())[:3]}"
