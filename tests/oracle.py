"""Comparing a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x.tolist() if hasattr(x, "tolist") else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(cell, r))) for r in frame.itertuples(index=False, name=None))


def same(df, con, sql):
    mine, theirs = df.toPandas(), con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
