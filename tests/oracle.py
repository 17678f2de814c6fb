"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """(number of rows, what differs or '')."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return len(ours[1]), f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return len(ours[1]), f"{len(ours[1])} and {len(theirs[1])} rows; only Spark: {sorted(a - b)[:2]}; only SQL: {sorted(b - a)[:2]}"
    return len(ours[1]), ""
