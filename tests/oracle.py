"""Comparison of a query with its SQL in DuckDB, independent of row order."""

from __future__ import annotations

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert ours == theirs
