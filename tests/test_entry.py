"""The driver's entry points, and registered queries against their SQL."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillgrid.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc"] and df.count() > 0


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    got = [plain(tuple(r)) for r in df.select(*names).collect()]
    assert sorted(got, key=repr) == sorted(map(plain, result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_training_package(tmp_path):
    """A copy without the subpackage and the pipeline imports, with the engine's own queries."""
    import shutil

    shutil.copytree(f"{ROOT}/quillgrid", tmp_path / "quillgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'postings' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
