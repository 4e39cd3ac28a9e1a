"""Every registered survey query against its SQL."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers all queries)
from earshot.plans.base import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r) for r in got.select(*names).collect()) == plain(cursor.fetchall())
