"""Runs a query and its SQL on the same tables and compares rows without regard to order."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool | str | bytes):
        return value
    if isinstance(value, decimal.Decimal | float | int):
        return f"{float(value):.9g}"
    if isinstance(value, dt.datetime | dt.date):
        return str(value)
    return str(value)


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[Counter, Counter, int]:
    """Rows only Spark has, rows only SQL has, rows in all."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = rows(names, cursor.fetchall())
    return got - want, want - got, sum(got.values())
