"""Run a registered query and its SQL answer on the same parquet tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

from parcelscope.plans.catalog import DRIVER_TABLES, Query, with_steps
from parcelscope.plans.driver_tables import Tables


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in DRIVER_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(tuple(_cell(row[at]) for at in order) for row in rows)


def compare(spark, connection, query: Query, folder: str):
    """Both results as sorted rows of text; the column names must agree."""
    df = query.run(Tables(spark, folder))
    spark_rows = rows_of(df.columns, [tuple(row) for row in df.collect()])
    cursor = connection.execute(with_steps(query.sql))
    names = [item[0] for item in cursor.description]
    assert sorted(names) == sorted(df.columns), f"{query.name}: {sorted(names)} against {sorted(df.columns)}"
    return spark_rows, rows_of(names, cursor.fetchall())
