"""Every query with SQL gives the SQL's rows; the entry imports without the corpus operators."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sievetree.plans import queries as estimator

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def value(x):
    if isinstance(x, float):
        return float(f"{x:.8g}")
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(estimator.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(value, r)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.p <= 1 for r in rows)


def test_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    os.makedirs(tmp_path / "sievetree")
    for name in os.listdir(f"{root}/sievetree"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/sievetree/{name}", tmp_path / "sievetree" / name)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hist_leaf' in q and not any(n.startswith('op') for n in q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
