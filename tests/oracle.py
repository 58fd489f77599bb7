"""Comparison of a query with its SQL in DuckDB, whatever the order of rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def shown(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
