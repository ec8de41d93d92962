"""Comparing a query with its SQL, as sets of rows with floats to six digits."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(df, *columns):
    names = columns or df.columns
    return sorted((tuple(plain(r[c]) for c in names) for r in df.select(*names).collect()), key=repr)


def check(spark, query, sql, scale="sf0.001"):
    folder = DATA / scale
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = query(spark, str(folder))
    names = sorted(df.columns)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert rows(df, *names) == expected
