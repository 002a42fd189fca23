"""Rows of a Spark result and of a DuckDB result, in one comparable form."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_value(v) for v in r) for r in df.itertuples(index=False))
