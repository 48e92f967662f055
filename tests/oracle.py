"""Spark rows against DuckDB rows, order aside."""

import os

import duckdb
import pandas as pd


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    frame = con.sql(sql).df()
    return sorted(frame.columns), normal(frame)


def normal(frame):
    def text(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(round(v, 6))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, row)) for row in frame.astype(object).values.tolist())


def same(df, sql, folder):
    columns, wanted = rows_of_sql(sql, folder)
    frame = df.toPandas()
    assert sorted(frame.columns) == columns
    assert normal(frame) == wanted
