"""Every catalogued query against its SQL on the smallest tables, where they are there."""

import os

import duckdb
import pytest

from lodeframe.plans import catalogue
from lodeframe.session import TABLES

SF = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(catalogue.queries())[:: int(os.environ.get("CATALOGUE_STEP", "1"))]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(_norm, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql := catalogue.oracle_sql().get(name):
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
        assert sorted(names) == cols and got == want
