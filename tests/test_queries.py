"""Every registered surface query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from gridloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if not isinstance(v, str) else v
    return cols, sorted((tuple(map(cell, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert list(got.columns)
