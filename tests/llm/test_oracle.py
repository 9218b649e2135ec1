"""The corpus queries that SQL can express, against their SQL."""

import duckdb
import pytest

from prudentia.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted("|".join(map(plain, r)) for r in found.select(*columns).collect())
    cursor = con.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in order) for r in cursor.fetchall())
