"""Helpers of these tests."""

import os

import duckdb


def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con
