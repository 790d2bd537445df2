"""Run registered queries beside their checking SQL and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tidemark.plans.stand_ins import TABLES


def checker(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(df, connection, sql: str) -> str | None:
    """None when both agree, else what differs."""
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: only here {[r for r in got if r not in set(want)][:2]}"
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(pairs)} rows differ, e.g. {pairs[0]}"
    return None
