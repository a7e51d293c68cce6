"""Comparison of a Spark result with DuckDB's, without regard to the order of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path if path.is_file() else path / '*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None if equal, else what differs."""
    con.execute(sql)
    columns = [d[0] for d in con.description]
    expected = rows_of(columns, con.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}; {[x for x in got if x not in expected[:2000]][:2]} {[x for x in expected if x not in got[:2000]][:2]}"
    for a, b in zip(got, expected, strict=True):
        if a != b:
            return f"{a} is not {b}"
    return None
