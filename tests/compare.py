"""Row-by-row comparison of a registered Spark query with its DuckDB counterpart."""

from __future__ import annotations

import math
import time

import duckdb

from plateworks.plans.bindings import DRIVER_TABLES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, type(x).__name__, str(x)) for x in r))


def compare(spark, con, name, queries, oracles, folder):
    """(ok, message)"""
    start = time.time()
    df = queries[name](spark, folder)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in oracles:
        return True, f"{name}: rows only, {len(got)} rows, {spent:.1f}s"
    start = time.time()
    rel = con.sql(oracles[name])
    want_cols, want = _rows(rel.columns, rel.fetchall())
    note = f"{len(got)} rows, spark {spent:.1f}s, sql {time.time() - start:.1f}s"
    if got_cols != want_cols:
        return False, f"{name}: columns {got_cols} != {want_cols}"
    types = {c: t for c, t in df.dtypes}
    odd = [f"{c}:{types[c]}/{t}" for c, t in zip(rel.columns, map(str, rel.types))
           if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
               "timestamp_ntz": "TIMESTAMP", "date": "DATE"}.get(types[c]) != t]
    if odd:
        return False, f"{name}: types {odd}"
    if got != want:
        if len(got) != len(want):
            only = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
            return False, f"{name}: {note}: {len(got)} != {len(want)} rows; {str(only)[:900]}"
        diff = next((a, b) for a, b in zip(got, want) if a != b)
        cells = [(c, str(a)[:200], str(b)[:200]) for c, a, b in zip(got_cols, *diff) if a != b]
        bad = sum(a != b for a, b in zip(got, want))
        return False, f"{name}: {note}: {bad} rows differ, first: {cells} key={str(diff[0])[:120]}"
    return True, f"{name}: {note}"
