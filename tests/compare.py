"""Compares what Spark and DuckDB return for the same query over the same tables."""

from __future__ import annotations

import datetime
import decimal
import os
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str | Path) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, decimal.Decimal):
        return float(x) if x % 1 else int(x)
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if isinstance(x, datetime.datetime):
        return str(x)
    return x


def rows_of_spark(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)


def rows_of_sql(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = c.sql(sql)
    names = list(found.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def same(df: DataFrame, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows; else what differs first."""
    names, want = rows_of_sql(c, sql)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    got = rows_of_spark(df)
    if got == want:
        return ""
    odd = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
    return f"{len(got)} and {len(want)} rows; first difference {odd}"
