"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import os

import duckdb
import pandas as pd

DIR = "/root/testdata/sf0.001"


def connect(d: str = DIR):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(d):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "NULL"
        if isinstance(x, str) or hasattr(x, "year"):
            return str(x).removesuffix(" 00:00:00")
        return f"{float(x):.6g}"

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


def same(spark, con, query, sql: str, d: str = DIR) -> None:
    got, want = query(spark, d).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
