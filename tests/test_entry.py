import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from orbweaver.plans.queries import ORACLES, QUERIES

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() <= entry.queries().keys()


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 191


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = tables.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_the_rest_does_without_the_subpackage(tmp_path):
    for name in os.listdir(TOP):
        if name not in ("corpus_pipeline.py", ".git"):
            os.symlink(f"{TOP}/{name}", tmp_path / name) if name != "orbweaver" else os.mkdir(tmp_path / name)
    for name in os.listdir(f"{TOP}/orbweaver"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{TOP}/orbweaver/{name}", tmp_path / "orbweaver" / name)
    # an operator's library that is missing takes the training-data queries with it, and no others
    blocked = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e, orbweaver.plans.queries as q; assert e.queries().keys() == q.QUERIES.keys()"
    subprocess.run([sys.executable, "-B", "-c", blocked], cwd=TOP, check=True, timeout=120)
    code = "import __spark_entry__ as e, orbweaver.plans.queries as q; assert e.queries().keys() == q.QUERIES.keys() and e.oracle_sql().keys() == q.ORACLES.keys()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
