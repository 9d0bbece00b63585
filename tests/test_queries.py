"""Every core query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import TABLES, canonical

from skygrid.plans import catalogue

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, D).toPandas()
    if name in catalogue.SQL:
        a, b = canonical(got), canonical(db.sql(catalogue.SQL[name]).df())
        assert list(a.columns) == list(b.columns)
        assert a.equals(b)


def test_core_does_not_name_the_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "skygrid")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "skygrid.llm" not in open(os.path.join(folder, n)).read()


@pytest.mark.parametrize("name", ["clip", "clip_union", "remap", "grd_scan", "fill_na"])
def test_every_day_is_there(spark, name):
    got = catalogue.QUERIES[name](spark, D)
    assert [r["pos"] for r in got.select("pos").distinct().sort("pos").collect()] == list(range(10958)) and "pos <" not in catalogue.SQL[name]


def test_core_runs_without_the_subpackage():
    code = "import sys; sys.modules['skygrid.llm'] = None; import __spark_entry__ as e; assert 'dr' in e.queries() and 'p4_found' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": root}).returncode == 0
