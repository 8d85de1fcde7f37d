"""Runs a query and its SQL side by side and compares names, types and the rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


# What a Spark type is called on the other side.
SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for column in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[column]):
            frame = frame.assign(**{column: frame[column].astype("float64")})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when query and SQL give the same names, types and rows, else what is wrong."""
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    ours = {name: SAME_TYPE.get(kind, kind) for name, kind in df.dtypes}
    if ours != types:
        return f"types {sorted(set(ours.items()) ^ set(types.items()))}"
    a, b = _sorted(df.toPandas()), _sorted(con.execute(sql).fetch_df())
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for column in a.columns:
        x, y = a[column], b[column]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            at = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{column}: {int((~same).sum())} values, first {x[at]!r} / {y[at]!r}"
    return None
