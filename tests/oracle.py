"""Spark queries against their SQL on the same small tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v: object) -> object:
    return round(v, 5) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


def table(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(spark, query, sql: str, folder: str = FOLDER) -> bool:
    df = query(spark, folder)
    with connect(folder) as con:
        want = con.execute(sql)
        return table(df.columns, df.collect()) == table([d[0] for d in want.description], want.fetchall())
