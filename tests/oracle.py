"""Compares queries with their SQL run by DuckDB over the same tables."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in cur.fetchall())


def rows_of_query(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[c]) for c in names) for r in df.collect())
