"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from suitescope.plans import catalogue

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def test_each_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    ours = catalogue.QUERIES[name](spark, DATA)
    theirs = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(round(float(x), 4) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows), key=repr)
    assert plain(tuple(r[n] for n in names) for r in ours.collect()) == plain(theirs.fetchall())


def test_the_rest_stands_without_the_text_operators(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) == len(catalogue.QUERIES)
