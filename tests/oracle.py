"""Runs a query's SQL in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(r[i]) for i in order) for r in rows)


def compare(frame, con, sql: str) -> tuple[Counter, Counter]:
    """Rows that only Spark has, and rows that only DuckDB has."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = rows_of(names, found.fetchall())
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    return got - want, want - got
