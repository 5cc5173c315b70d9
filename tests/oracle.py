"""Compare a query with its SQL in DuckDB on the same Parquet files."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([cell(v) for v in x])
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and abs(x) < 1e9 else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))
