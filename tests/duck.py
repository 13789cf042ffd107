"""Running a query's DuckDB form and comparing rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def views(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"create view {name} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        if isinstance(v, int | np.integer) or (isinstance(v, float | np.floating) and float(v).is_integer()):
            return str(int(v))
        return repr(float(v)) if isinstance(v, float | np.floating) else repr(v)

    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))
