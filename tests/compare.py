"""A query's rows against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in os.listdir(folder):
        c.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{folder}/{t}')")
    return c


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    names = list(got.columns)
    assert sorted(names) == sorted(want.columns)
    got, want = (d[names].astype(object).where(d[names].notna(), None).sort_values(names, ignore_index=True, key=lambda c: c.map(repr)) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
