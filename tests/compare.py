"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, statement: str) -> str | None:
    """None where both results agree, else a short account of the first difference."""
    cursor = connection.execute(statement)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    expected = rows_of(names, cursor.fetchall())
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(expected) != len(found):
        return f"{len(found)} rows against {len(expected)}"
    for ours, theirs in zip(found, expected):
        if ours != theirs:
            return f"{ours} against {theirs}"
    return None
