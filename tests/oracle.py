"""Run a query in Spark and its SQL in DuckDB over the same tables, and compare."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
