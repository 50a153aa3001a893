"""Every registered query with a SQL twin, on the smallest data set."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from hostelry.registry import load
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
SQL = {name: q.sql for name, q in load().items() if q.sql is not None}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", [n for n in SQL if n != "alc01_conservation"])
def test_matches_sql(spark, db, name):
    df = load()[name].run(spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(SQL[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_names_and_sql_line_up():
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone,loads", [("hostelry.llm", True), ("corpus_pipeline", True), ("public_tokenizers", True), ("hostelry.session", False)])
def test_entry_without_optional_parts(gone, loads):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
assert len(entry.queries()) > 200 and not any(n.startswith("op") for n in entry.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert (done.returncode == 0) == loads, done.stderr
