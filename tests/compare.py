"""Rows of Spark and DuckDB results in one comparable form."""

from __future__ import annotations

import math

import duckdb

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "year"):
        return str(value).removesuffix("+00:00")
    return int(value) if value == int(value) else float(value)


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())
