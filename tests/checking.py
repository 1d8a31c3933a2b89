"""Run a registered query and its SQL on the same files and compare."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import numpy as np

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(df, con, sql, got=None):
    """What differs between a DataFrame and a SQL result, or None."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if not expected:
        return "the checking SQL gives no rows, so it checks nothing"
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = df.collect() if got is None else got
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for mine, other in zip(rows_of(df.columns, got), rows_of(names, expected)):
        if mine != other:
            return f"\n  spark {mine[:1500]}\n  sql   {other[:1500]}"
    return None
