"""Run every query beside its SQL and report differences: python tests/compare.py [sf_dir] [name …]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normalized(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    # Whole numbers with nulls come as doubles from one side and as integers from the other.
    frame = frame.apply(lambda c: c.astype("Int64") if c.dtype.kind == "f" and c.hasnans and (c.dropna() % 1 == 0).all() else c)
    frame = frame.astype(object).where(frame.notna(), None)
    rows = sorted(map(repr, frame.itertuples(index=False, name=None)))
    return list(frame.columns), rows


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    columns, rows = normalized(spark_frame)
    sql_columns, sql_rows = normalized(sql_frame)
    if columns != sql_columns:
        return f"columns {columns} and {sql_columns}"
    if rows != sql_rows:
        only = sorted(set(rows) - set(sql_rows))[:2]
        only_sql = sorted(set(sql_rows) - set(rows))[:2]
        return f"{len(rows)} and {len(sql_rows)} rows; only here {only}; only in SQL {only_sql}"
    return None


if __name__ == "__main__":
    from bench import session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = session()
    connection = connect(folder)
    failed = []
    for name in names:
        start = time.time()
        try:
            frame = entry.queries()[name](spark, folder).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            problem = None if sql is None else difference(frame, connection.execute(sql).df())
            note = "no SQL" if sql is None else problem or "same"
        except Exception as error:
            took, problem, note = time.time() - start, "error", f"{type(error).__name__}: {str(error)[:1500]}"
            frame = []
        if problem:
            failed.append(name)
        print(f"{name:28s} {len(frame):8d} rows {took:6.2f} s  {note[:1500]}", flush=True)
    print("failed:", failed)
