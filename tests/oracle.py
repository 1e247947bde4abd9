"""Run a query on Spark and its oracle on DuckDB and compare the rows as multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def plain(value):
    """Exact types: an int never equals a float, and floats keep nine significant digits."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, dt.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, dt.date):
        return ("date", value.isoformat())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(con, df, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = df.collect()
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"columns: spark {sorted(df.columns)} oracle {sorted(want_columns)}"
    if len(got) != len(want):
        return f"rows: spark {len(got)} oracle {len(want)}"
    left, right = rows_of(df.columns, got), rows_of(want_columns, want)
    if left != right:
        return (
            f"columns {sorted(df.columns)}\n  only spark {list((left - right).items())[:3]}\n"
            f"  only oracle {list((right - left).items())[:3]}"
        )
    return None
