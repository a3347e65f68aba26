"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import pytest

from tallyframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert columns
        return
    twin = duck.sql(catalog.ORACLES[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=repr)
    assert len(rows) == len(expected) and all(same(x, y) for a, b in zip(rows, expected) for x, y in zip(a, b))


def test_every_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
