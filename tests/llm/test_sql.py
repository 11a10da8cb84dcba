"""The operators that SQL can express, against it, on the smallest tables."""

import duckdb
import pytest

from conftest import folder
from test_catalog import rows
from tracewash.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{folder('sf0.001')}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder("sf0.001")).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
