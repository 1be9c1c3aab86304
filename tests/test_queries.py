"""Registered queries of the library's own operators against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from locusframe.plans import proxies, proxies_candidates, proxies_evaluation  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{float(value):.6f}" if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", list(proxies.ORACLE_SQL))
def test_query(spark, duck, name):
    df = proxies.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(proxies.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall()) and got


@pytest.mark.parametrize("name", sorted(set(proxies.QUERIES) - set(proxies.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert proxies.QUERIES[name](spark, SF).count() > 0


def test_range_joins_are_hash_or_merge_joins(spark):
    for name in ("region_semi_join", "local_depth", "nearest_edge", "liftover"):
        plan = proxies.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
