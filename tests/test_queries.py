"""Every query of the graph against its SQL, on the smallest tables."""

import duckdb
import pytest

from prudentia.plans import batch_queries, evaluation_queries, graph_queries, store_queries, text_queries

FOLDER = "/root/testdata/sf0.001"
SQL = graph_queries.SQL | text_queries.SQL | batch_queries.SQL | store_queries.SQL | evaluation_queries.SQL
QUERIES = graph_queries.QUERIES | text_queries.QUERIES | batch_queries.QUERIES | store_queries.QUERIES | evaluation_queries.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("part", "lineitem", "customer", "orders", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted("|".join(map(plain, r)) for r in found.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in order) for r in cursor.fetchall())
