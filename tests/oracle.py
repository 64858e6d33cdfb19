"""Spark results against SQL run by DuckDB over the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(map(one, v))
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(v) for v in row) for row in df.where(df.notna(), None).itertuples(index=False))


def check(spark, sf_dir, query, sql):
    made = query(spark, sf_dir).toPandas()
    want = connect(sf_dir).sql(sql).df()
    assert sorted(made.columns) == sorted(want.columns)
    a, b = canonical(made), canonical(want)
    assert a == b, (len(a), len(b), sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
