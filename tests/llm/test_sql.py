"""The queries that SQL can express against it."""

import duckdb
import pytest

from leafmill.llm import queries

TABLES = "documents pages benchmark labels".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr([row[c] for c in columns]) for row in df.collect())
    result = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
