"""Run a query and its SQL side by side and compare the rows."""

import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def expected(con, sql: str):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())
