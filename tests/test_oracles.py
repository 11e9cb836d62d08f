"""Every registered query beside its oracle on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# Hundreds of boosting rounds; exercised with smaller settings in the other tests, and whole by compare.py.
SLOW = {"gbt_real", "gbt_mixed", "evaluate_pair"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in entry.oracle_sql():
        assert compare(df, duck, entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 11
