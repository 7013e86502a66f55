"""Every query of the engine against its SQL on the smallest data."""

import glob
import os
from collections import Counter

import pytest

from lodestone.plans.oracle import SQL
from lodestone.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    fixed = lambda v: None if v is None or v != v else float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return Counter(tuple(fixed(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        order = [d[0] for d in want.description]
        assert sorted(order) == columns
        assert plain(got) == plain(tuple(r[order.index(c)] for c in columns) for r in want.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
