"""Comparing a registered query with its SQL, as sets of rows with columns by name."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(sf_dir=DATA):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, queries, sql, name, sf_dir=DATA):
    df = queries[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql[name])
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want, strict=True) if g != w)
    return len(got)
