"""Every query with SQL gives the rows that DuckDB gives, in values and in column names."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from runlens.plans import catalog

SF = os.environ.get("RUNLENS_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_and_sql_agree(name, spark, duck):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    a, b = table(got.columns, [tuple(r) for r in got.collect()]), table(want.columns, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]


def test_entry_and_every_other_query(spark):
    assert entry.entry(spark).count() > 0
    for name, f in catalog.QUERIES.items():
        if name not in catalog.ORACLES:
            assert f(spark, SF).columns
