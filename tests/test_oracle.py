"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pennyflow import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "-" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, db, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), db.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_has_no_nested_loop(spark):
    plan = plans.queries()[plans.FLAGSHIP](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
