"""Compares a query's rows with its DuckDB oracle, column order and row order aside."""

import datetime
import decimal
import glob
import math
import os
import numbers

import duckdb


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, numbers.Number):
        if isinstance(x, float) and math.isnan(x):
            return None
        return int(x) if x == int(x) and abs(x) < 1e15 else float(f"{float(x):.9g}")
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def agrees(df, sql, sf_dir):
    got = table(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out = con.execute(sql)
    want = table([c[0] for c in out.description], out.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
