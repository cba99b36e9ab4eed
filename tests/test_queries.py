import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pointtide import catalog


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, db, small, name):
    df = catalog.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = db.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_name", "row_key", "field_name"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
