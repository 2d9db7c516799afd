"""Run a registered query on Spark and its SQL on DuckDB and compare the full results."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides agree exactly."""
    got_cols, got = normalised(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    want_cols, want = normalised([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return [f"columns differ: only spark {set(got_cols) - set(want_cols)}, only sql {set(want_cols) - set(got_cols)}"]
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = set(got), set(want)
        out += [f"only spark: {dict(zip(got_cols, r))}" for r in sorted(a - b, key=str)[:2]]
        out += [f"only sql:   {dict(zip(got_cols, r))}" for r in sorted(b - a, key=str)[:2]]
        out.append(f"{len(a - b)} rows only in spark, {len(b - a)} only in sql")
    return out
