"""Holds a Spark result against DuckDB's, by names and values in any order."""

import datetime
import math
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in data)


def assert_same(df, sql, sf_dir):
    found = duck(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, found.fetchall())
    assert len(got) == len(want)
    assert got == want
