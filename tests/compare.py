"""Runs a query and its SQL and compares the rows as multisets."""

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, int):
        return v
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def same(df, con, sql):
    got = rows(df.columns, df.collect())
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    want = rows(names, r.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
