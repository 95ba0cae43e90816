"""The driver's contract: names, columns, and every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = set()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline" and n not in QUICK]


def canonical(df):
    df = df[sorted(df.columns)]
    plain = df.map(lambda x: "null" if x is None or x != x else repr(round(float(x), 8)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x))
    return plain.sort_values(list(plain.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got).equals(canonical(want))
    else:
        assert len(got)


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
