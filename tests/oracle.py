"""Compares a query's rows with those of its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"


def plain(v):
    """Whole numbers, texts, dates and truth values as they are; fractions to nine digits."""
    if v is None or isinstance(v, bool | int | str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return "nan" if math.isnan(v) else float(f"{float(v):.9g}")


def assert_same(spark, query, sql, d=D):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df, q = query(spark, d), con.sql(sql)
    names = list(q.columns)
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(plain(x) for x in r) for r in q.fetchall())
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == want
