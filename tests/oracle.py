"""Comparing a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

from evalspark.plans.adapters import BASE


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_value(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
    )


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns, types and rows, else what differs first."""
    got_columns = spark_df.columns
    got = spark_df.collect()
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if len(a) != len(b):
        only = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"{len(a)} rows != {len(b)}; {only}"
    for x, y in zip(a, b):
        if x != y or [_kind(v) for v in x] != [_kind(v) for v in y]:
            return f"{x} != {y}"
    return None
