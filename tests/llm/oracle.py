"""Comparison of a query's rows with its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame


def same_as_sql(df: DataFrame, sql: str, folder: str) -> None:
    """The rows of the SQL on the folder's tables are those of the query, in any order."""
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in relation.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want
