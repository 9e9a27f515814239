"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexigrove.plans import oracle, queries
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(sql.sql(oracle.oracle_sql()[name]).df())


def test_rows_only_queries(spark):
    for name in set(queries.queries()) - set(oracle.oracle_sql()):
        assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_html_to_text_on_odd_pages(spark, tmp_path):
    """Long pages, containers and letters, blanks and line ends beyond ASCII, as the SQL form has them."""
    pages = [
        "<body>" + "y" * 100_010, "<body>  a </body>", "<body>a \u0085</body>", "<body>\x0ba   </body>",
        '<html><body><ul class="description"><heading>Field</heading><li>One</li></ul><p>rest</p></body></html>',
        "<body><scripté>x</script>a<ſcript>y</script>b<STYLE>z</style>c<navy>d</nav>e<nav_x>f</nav></body>", "", None,
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(oracle.oracle_sql()["html_to_text"]).fetchall())
    assert sorted(map(tuple, queries.queries()["html_to_text"](spark, str(tmp_path)).collect())) == want
