"""The operators' queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from locusframe.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return "null" if value is None or (isinstance(value, float) and math.isnan(value)) else str(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == expected and expected
