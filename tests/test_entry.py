"""The driver's three functions, and queries against SQL on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from linkloom.plans import queries

ROOT = Path(__file__).resolve().parent.parent
DATA = entry.SMALLEST

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_rows_without_sql(spark):
    edges = queries.mst_edges(spark, DATA)
    assert edges.count() == queries.node_degrees(spark, DATA).count() - 1
    labels = queries.hdbscan_labels(spark, DATA).groupBy("cluster").count().collect()
    assert all(r["count"] >= 5 for r in labels if r.cluster >= 0)
    found = {r.cluster for r in labels} - {-1}
    assert found == set(range(len(found)))


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for part in ("__spark_entry__.py", "linkloom"):
        (shutil.copytree if (ROOT / part).is_dir() else shutil.copy)(ROOT / part, tmp_path / part)
    shutil.rmtree(tmp_path / "linkloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'jaccard' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
