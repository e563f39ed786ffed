"""Every registered query against its SQL twin on the smallest driver tables."""

import glob
import math
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    data = [tuple(r) for r in got.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert data
        return
    rel = duck.sql(sql)
    assert sorted(got.columns) == sorted(rel.columns)
    assert rows(got.columns, data) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv", "n_pairs", "mean_guest_tokens", "mean_host_tokens"]


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("turnwise/llm", "tests/llm"), ("turnwise/llm", "tests/llm", "corpus_pipeline.py"), ("turnwise/llm/catalog.py",)])
def test_entry_without_the_operators_for_training_data(tmp_path, gone):
    """Without their folders (or with what is left of them) the entry has all other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    left = shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md")
    shutil.copytree(root, tmp_path / "repo", ignore=lambda folder, names: set(left(folder, names)) | {
        n for n in names if os.path.relpath(os.path.join(folder, n), root) in gone})
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=True).stdout
    assert out.split() == sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")
