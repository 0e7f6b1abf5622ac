"""Compares queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    return v


def differences(spark, name, query, sql, sf_dir) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    theirs_columns = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    df = query(spark, sf_dir)
    ours_columns = df.columns
    ours = [tuple(r) for r in df.collect()]
    if sorted(ours_columns) != sorted(theirs_columns):
        return f"{name}: columns {ours_columns} and {theirs_columns}"

    def canon(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)

    a, b = canon(ours, ours_columns), canon(theirs, theirs_columns)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]
        return f"{name}: {len(a)} and {len(b)} rows, first differences {odd}"
    return ""
