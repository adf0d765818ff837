"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        source = f if os.path.isfile(f) else f"{f}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return c


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "__len__") and not isinstance(v, (str, dict, bytes)):
        return tuple(map(_plain, v))
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(_plain(v) for v in r)) for r in df.itertuples(index=False))
