"""Runs every registered query against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(float(v), 4) if isinstance(v, float) and not math.isnan(v) else v
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def differ(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.sql(sql)
    b = rows(got.columns, got.fetchall())
    if a == b:
        return None
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    x, y = set(map(repr, a[1])), set(map(repr, b[1]))
    return f"{len(a[1])} / {len(b[1])} rows; only here {sorted(x - y)[:3]}; only in SQL {sorted(y - x)[:3]}"
