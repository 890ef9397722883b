"""Compares a query with its SQL on the tables of a folder."""

import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def check(spark, folder, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        at = f"{folder}/{f}" + ("/*" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want
