"""Every registered query against its SQL twin at the smallest scale."""

import os
import re

import pytest

import __spark_entry__ as entry
from tools.check import duck, rows_of

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\b(CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython)\b", plan)
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    con.execute(SQL[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, con.fetchall())


def test_flagship_plan(spark):
    """Top-n limits rows before the shuffle, and only needed columns are read."""
    df = entry.queries()["flagship_patient_log_loss"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "l_tax" not in plan and "l_shipdate" not in plan
    assert "Python" not in plan


def test_flagship_entry(spark):
    assert entry.entry(spark).columns == ["n", "log_loss"]
