"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def sort_key(row):
    return [(v is None, str(type(v).__name__), str(v)) for v in row]


def spark_rows(df):
    order = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    return order, sorted(rows, key=sort_key)


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    index = [names.index(c) for c in order]
    rows = [tuple(plain(r[i]) for i in index) for r in cursor.fetchall()]
    return order, sorted(rows, key=sort_key)


def difference(df, con, sql) -> str | None:
    """None when both sides agree, else a short account."""
    names, left = spark_rows(df)
    other, right = duck_rows(con, sql)
    if names != other:
        return f"columns {names} against {other}"
    kinds = {c: {type(r[i]).__name__ for r in left if r[i] is not None} for i, c in enumerate(names)}
    other_kinds = {c: {type(r[i]).__name__ for r in right if r[i] is not None} for i, c in enumerate(names)}
    if kinds != other_kinds:
        bad = {c: (kinds[c], other_kinds[c]) for c in names if kinds[c] != other_kinds[c]}
        return f"types {bad}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}; first {left[:2]} / {right[:2]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ in {names}: {wrong[:2]}"
    return None
