"""Every registered query with a SQL twin gives DuckDB's result on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from siltstone.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def canonical(value):
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr([canonical(r[names.index(c)]) for c in order]) for r in got.fetchall())
    assert sorted(repr([canonical(r[c]) for c in order]) for r in rows) == want
