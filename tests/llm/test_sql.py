"""The SQL of the numbered queries on the smallest given tables."""

import duckdb
import pytest

from earshot.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name, sql", [*queries.ORACLE_SQL.items(), ("op9_pii", queries.PII_BASE_SQL)])
def test_query_equals_sql(spark, duck, name, sql):
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert set(names) <= set(got.columns) and (name == "op9_pii" or len(names) == len(got.columns))
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
