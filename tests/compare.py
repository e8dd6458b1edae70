"""Order-free comparison of a query with its SQL."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.8g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return repr(bytes(v) if isinstance(v, bytearray) else v)


def connect(folder: str, tables: list[str]):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    at = [relation.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
