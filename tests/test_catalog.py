"""Every core query runs on the smallest tables and equals its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from segloom.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _norm(df):
    cols = sorted(df.columns)
    text = lambda v: "" if v is None or str(v) in ("NaT", "<NA>", "nan", "None") else f"{float(v):.5f}" if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")) else str(v)
    return cols, sorted(tuple(map(text, r)) for r in df[cols].values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, D).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert _norm(got) == _norm(duck.sql(sql).df())


def test_without_the_training_data_operators():
    assert not any(k.startswith("p") for k in catalog.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
