"""Every catalog query against its SQL twin in DuckDB, on the given tables."""

import math
import os

import duckdb
import pytest

from reelspark.plans import catalog, lookups, media, rules, shapes, stored  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(one(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert got == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_named_images_with_long_numbers(spark, tmp_path):
    """Numbers of more digits than a name has room for, against the SQL."""
    path = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"COPY (SELECT i AS l_orderkey, 1 + i % 4 AS l_linenumber, (7 * 10 ** (i % 6))::BIGINT + i AS l_suppkey, (3 * 10 ** (i % 10))::BIGINT + i AS l_partkey FROM range(40) AS r(i)) TO '{path}'")
    df = lookups.named_images(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    want = con.sql(catalog.ORACLE_SQL["named_images"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
