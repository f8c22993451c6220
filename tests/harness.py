"""Runs a registered query and its SQL and compares whole results."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TESTDATA = "/root/testdata"
TABLES = ("nation", "customer", "part", "orders", "lineitem", "events")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        raise AssertionError(f"zoned timestamp {value}")
    return value


def by_column(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(canonical(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_result(frame):
    return by_column(frame.columns, [tuple(row) for row in frame.collect()])


def duck_result(connection, sql):
    cursor = connection.execute(sql)
    return by_column([column[0] for column in cursor.description], cursor.fetchall())
