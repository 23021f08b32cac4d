"""Every registered query with SQL against DuckDB, and the rest for a stable schema."""

import math
import os

import duckdb
import pytest

from lodestrata.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows and df.columns
        return
    cursor = oracle.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(([normal(r[c]) for c in order] for r in rows), key=repr)
    want = sorted(([normal(r[names.index(c)]) for c in order] for r in cursor.fetchall()), key=repr)
    assert got == want
