"""Comparison of a query with its SQL on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def check(spark, query, sql):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = query(spark, DATA), con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    got = Counter(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    at = [names.index(c) for c in sorted(names)]
    want = Counter(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want
