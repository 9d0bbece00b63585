"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from compare import TABLES, canonical

from skygrid.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, D).toPandas()
    if name in queries.SQL:
        a, b = canonical(got), canonical(db.sql(queries.SQL[name]).df())
        assert list(a.columns) == list(b.columns)
        assert a.equals(b)
