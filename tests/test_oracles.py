"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import pytest

from plumetrics.plans.oracles import ORACLES
from plumetrics.plans.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("nation", "customer", "orders", "lineitem", "events")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


def _key(row):
    return tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF_DIR)
    result = sql.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.collect()), key=_key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if isinstance(a, float) and isinstance(b, float):
                assert math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6), (g, w)
            else:
                assert a == b, (g, w)
