"""Comparison of a query with its SQL in DuckDB, as sets of rows."""

import glob
import os

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def _rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def compare(spark, query, sql: str | None, folder: str = FOLDER) -> None:
    got = query(spark, folder).toPandas()
    if sql is None:
        return
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
