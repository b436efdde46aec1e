"""Every registered query against its SQL, and what the plans must not contain."""

import pytest
from oracle import connect, difference

from signalloom.catalog import ORACLES, QUERIES

ROWS_ONLY = {"g18_train_weighted_baseline"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    # Two-sided joins without an equal key would form all pairs of a group.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert name in ROWS_ONLY and df.count() > 0


def test_every_query_has_sql_unless_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 15
