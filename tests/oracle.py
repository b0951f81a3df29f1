"""Runs a query and its SQL, and compares columns, types and rows whatever their order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "item"):
        return value.item()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, name, query, sql, sf) -> list[str]:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(sql)
    names, types, expected = want.columns, [str(t) for t in want.types], want.fetchall()
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"{name}: columns {sorted(df.columns)} and {sorted(names)}"]
    alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    found = dict(df.dtypes)
    out += [f"{name}: {n} is {found[n]} and {t}" for n, t in zip(names, types, strict=True) if alike.get(found[n]) != t]
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    if a != b:
        pairs = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        out.append(f"{name}: {len(a)} and {len(b)} rows; first differences {pairs}")
    return out
