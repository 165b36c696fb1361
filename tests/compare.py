"""Compare a Spark result with a SQL result, as unordered rows."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(root) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, (Decimal, float)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(row[n]) for n in names) for row in df.collect()), key=repr)


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    found = [column[0] for column in cursor.description]
    names = sorted(found)
    places = [found.index(n) for n in names]
    return names, sorted((tuple(_cell(row[i]) for i in places) for row in cursor.fetchall()), key=repr)
