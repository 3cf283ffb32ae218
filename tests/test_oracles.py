"""Queries against DuckDB on the driver's smallest tables, where they are there."""

import collections
import decimal
import os

import pytest

from plumbline.plans import catalogue

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables aren't here")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, connection, name):
    df = catalogue.QUERIES[name](spark, TABLES)
    names = sorted(df.columns)
    found = connection.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v + 0.0 if isinstance(v, float) else v
    want = collections.Counter(repr([plain(r[columns.index(c)]) for c in names]) for r in found.fetchall())
    assert collections.Counter(repr([plain(r[c]) for c in names]) for r in df.collect()) == want


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
