"""Run named queries on Spark and their SQL on DuckDB and compare rows as sets of values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

from riskloom.sources.samples import TABLE_NAMES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value.normalize()) if value else "0")
    if isinstance(value, float):
        return ("double", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, int):
        return ("int", str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return (type(value).__name__, value.isoformat())
    return (type(value).__name__, str(value))


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(row[n]) for n in names) for row in df.collect())


def rows_of_duckdb(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    names = sorted(found)
    at = [found.index(n) for n in names]
    return names, sorted(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs first."""
    left_names, left = rows_of_spark(df)
    right_names, right = rows_of_duckdb(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}: spark only {only_left}, duckdb only {only_right}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference: spark {a} duckdb {b}"
    return None if left else "no rows on either side"
