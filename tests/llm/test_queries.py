import duckdb
import pytest

from corpusmill.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_distinct_rows(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    db = duckdb.connect()
    for table in ("chunks", "index_runs", "search_results", "documents", "benchmark"):
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, SMALL).collect())) == sorted(db.execute(SQL[name]).fetchall())
