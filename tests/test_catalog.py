"""Every query against its SQL, on the smallest tables, and rules for every plan."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, open_tables
from logprism.testbed.catalog import CATALOG


@pytest.fixture(scope="module")
def db():
    return open_tables("/root/testdata/sf0.001")


READERS = {"files_unreadable"}  # files are opened in Python tasks, so that a failure is a row


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, sf_dir, db, name):
    frame = queries()[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in READERS:
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert compare(frame, db, name) in ("", "no rows")


def test_entry(spark, sf_dir):
    assert entry(spark).count() > 250
    assert set(CATALOG) <= set(oracle_sql()) and set(CATALOG) <= set(queries())
