"""The queries of made-up columns against their SQL, on the smallest tables."""

import math
import os

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    import parley.plans.more as more

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    queries, sql, wrong = entry.queries(), entry.oracle_sql(), []
    mine = [n for n, f in queries.items() if f.__module__ == more.__name__]
    assert len(mine) > 40 and all(n in sql for n in mine)
    for n in mine:
        df = queries[n](spark, SMALL)
        cols = sorted(df.columns)
        got = sorted([plain(r[c]) for c in cols] for r in df.collect())
        want = con.execute(sql[n])
        at = [[d[0] for d in want.description].index(c) for c in cols]
        if got != sorted([plain(r[i]) for i in at] for r in want.fetchall()):
            wrong.append(n)
    assert not wrong
