"""SQL twins of the queries that have one, and what every query returns."""

import duckdb
import pytest

from lexigrove.llm import queries
from tests.conftest import SF
from tests.test_queries import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(c.sql(queries.ORACLE_SQL[name]).df())
