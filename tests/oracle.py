"""Holds a query against its SQL on the same tables."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) if isinstance(v, decimal.Decimal) else v


def key(row):
    return tuple((v is None, isinstance(v, str), v if isinstance(v, str) else "", float(v) if isinstance(v, int | float) else 0.0, str(v)) for v in row)


def ordered(columns, rows, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=key)


def check(spark, folder, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.columns, df.collect(), df.columns) == ordered(names, found.fetchall(), df.columns)
