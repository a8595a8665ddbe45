"""Runs a query and its SQL over one data folder and compares the rows."""

import math
import os
from collections import Counter

DATA = os.environ.get("LODESTONE_TESTDATA", "/root/testdata/sf0.001")


def connect(folder=DATA):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v.asDict().values())
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def assert_equal(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    answer = connect(folder).execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in answer.fetchall())
    assert got == want, (list((got - want).elements())[:3], list((want - got).elements())[:3])
