"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


_KINDS = {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows, names and types; else a short account."""
    names = df.columns
    got = _rows(names, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    if sorted(names) != sorted(rel.columns):
        return f"columns {sorted(names)} != {sorted(rel.columns)}"
    types = {f.name: _KINDS.get(f.dataType.typeName(), f.dataType.typeName()) for f in df.schema.fields}
    theirs = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if types != theirs:
        return f"types {types} != {theirs}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{sorted(names)}: {str(g)[:300]} != {str(w)[:300]}"
    return None
