"""Compares a query with its SQL in DuckDB on the same Parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(df, columns):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def same(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' * os.path.isdir(path)}'")
    got = query(spark, sf)
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert rows(got, columns) == sorted((tuple(_plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
