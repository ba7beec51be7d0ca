"""Compare queries with their SQL counterparts: columns, row count and every value."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs, in words; empty when all is equal."""
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want_types = dict(zip(want_columns, [str(d[1]) for d in result.description]))
    want = rows_of(want_columns, result.fetchall())
    got = rows_of(df.columns, df.collect())
    found = []
    if sorted(df.columns) != sorted(want_columns):
        found.append(f"columns {sorted(df.columns)} instead of {sorted(want_columns)}")
    if got != want:
        found.append(f"{sum(got.values())} rows instead of {sum(want.values())}")
        found.append(f"only here: {list((got - want).items())[:3]}")
        found.append(f"only in SQL: {list((want - got).items())[:3]}")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    for name, kind in df.dtypes:
        if kinds.get(kind) != want_types.get(name):
            found.append(f"type of {name}: {kind} / {want_types.get(name)}")
    return found
