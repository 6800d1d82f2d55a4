"""Spark results against the same query in SQL on another engine."""

import datetime

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.01"


def plain(v):
    if v is None or v is pd.NaT or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, datetime.date):
        return str(v)[:19].removesuffix(" 00:00:00")
    if hasattr(v, "__len__") and not isinstance(v, str):
        return tuple(map(plain, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 6) if isinstance(v, (int, float, np.number)) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


def compare(spark, name, query, sql, folder=FOLDER):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = rows(query(spark, folder).toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0], name
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1]):
        assert repr(a) == repr(b) or all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y))) for x, y in zip(a, b)), (name, a, b)
