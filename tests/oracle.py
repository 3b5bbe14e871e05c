"""Comparison of a query with its SQL on one data folder."""

from __future__ import annotations

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(a: tuple, b: tuple) -> bool:
    """Equal values; numbers by value, so a NaN equals nothing, not even a NaN."""
    return all(x == y or (x is None and y is None) for x, y in zip(a, b))


def rows(frame) -> list[tuple]:
    plain = lambda v: float(v) if isinstance(v, float) else None if v is None else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame), key=lambda r: tuple((v is None, str(v)) for v in r))


def check(spark, query, sql: str, folder: str = FOLDER) -> None:
    a = query(spark, folder)
    con = connect(folder).execute(sql)
    columns, theirs = sorted(a.columns), [c[0] for c in con.description]
    assert columns == sorted(theirs)
    x = rows(([r[c] for c in columns] for r in a.collect()))
    y = rows(([r[theirs.index(c)] for c in columns] for r in con.fetchall()))
    assert len(x) == len(y)
    assert not [(p, q) for p, q in zip(x, y) if not same(p, q)][:5]
