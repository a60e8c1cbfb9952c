"""Every query runs on the small tables, and gives the rows of its SQL where there is one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from wordvane.plans import catalog, modules

modules()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    frame = entry.queries()[name](spark, sf)
    if name not in catalog.SQL:
        assert frame.count() > 0
        return
    found = con.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    want = sorted(str([tidy(v) for v in row]) for row in found.fetchall())
    assert sorted(str([tidy(v) for v in row]) for row in frame.select(*names).collect()) == want
    assert want


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "rank" in frame.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
