"""Spark results held against DuckDB texts on the same files."""

import decimal
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(d=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(d):
        p = f"{d}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if isinstance(v, decimal.Decimal) else v


def compare(df, sql, con):
    cols = sorted(df.columns)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == expected
