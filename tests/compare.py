"""Runs a query and its SQL over the same Parquet files and compares the rows."""

import os

import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return ""
    if type(v).__name__ in ("date", "datetime", "Timestamp"):
        return str(v)[:10]
    return str(v)


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == bool or pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(6)
        else:
            df[c] = df[c].map(_plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, con, sql):
    got, want = normal(spark_df.toPandas()), normal(con.execute(sql).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float and want[c].dtype == float:
            assert np.allclose(got[c], want[c], rtol=1e-7, atol=1e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
