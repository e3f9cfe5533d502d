"""Compares a query with its SQL as rows of normalised values, columns by name."""

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir, threads=4):
    con = duckdb.connect(config={"threads": threads})
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """The columns of both and the rows that only one of them has."""
    rel = con.sql(sql)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    a, b = sorted(df.columns), sorted(rel.columns)
    if a != b:
        return [("columns", a, b)]
    if len(mine) != len(theirs):
        return [("count", len(mine), len(theirs))]
    return [(x, y) for x, y in zip(mine, theirs, strict=True) if x != y][:5]
