"""Compare a query with its SQL on the same tables, as sets of rows with names sorted."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, bytearray):
        return bytes(x)
    if hasattr(x, "asDict"):
        return tuple(_plain(v) for v in x)
    return x


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, sf_dir: str, query, sql: str) -> tuple[int, str]:
    """Row count and, if they differ, what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return 0, f"columns {df.columns} and {names}"
    if got != want:
        return 0, f"only here {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}, {sum(got.values())} and {sum(want.values())} rows"
    return sum(got.values()), ""
