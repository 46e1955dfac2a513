"""Run a query in Spark and its SQL twin in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os
import re

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _kind(arrow_type) -> str:
    return re.sub(r"<\w+: ", "<", str(arrow_type).replace("large_", ""))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the difference."""
    con = connect(sf_dir)
    table = con.sql(sql).arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    got = query(spark, sf_dir).toArrow()
    if sorted(got.column_names) != sorted(table.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(table.column_names)}"
    for field in got.schema:
        other = table.schema.field(field.name).type
        if _kind(field.type) != _kind(other):
            if not (str(field.type).startswith("timestamp") and str(other).startswith("timestamp")):
                return f"type of {field.name}: {field.type} != {other}"
    a = _rows(got.column_names, zip(*[c.to_pylist() for c in got.columns])) if got.num_rows else []
    b = _rows(table.column_names, zip(*[c.to_pylist() for c in table.columns])) if table.num_rows else []
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"row {x} != {y}"
    return None if a else "no rows at all"
