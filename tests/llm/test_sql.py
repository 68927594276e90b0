"""The contracts that SQL can express, by SQL, over the smallest tables; and every query's whole table."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from linkloom.llm import queries

DATA = entry.SMALLEST

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_every_operator_has_its_query():
    assert [n for n in entry.queries() if n.startswith("op") or n == "pipeline"] == [*queries.QUERIES, "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
