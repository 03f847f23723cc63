"""Every query with SQL gives the rows that DuckDB gives; the others run. On the smallest data."""

import glob
import math
import os

import pytest

from leafwright import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "hour"):
        return str(v)[:19]
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    rows = got.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = duck.execute(sql)
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(got.columns)
    assert table(got.columns, rows) == table(columns, r.fetchall())
