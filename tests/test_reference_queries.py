import os

import duckdb
import pytest
from conftest import DATA

from locusframe import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    want = sorted(db.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({ORACLES[name]})").fetchall(), key=repr)
    assert got == want
