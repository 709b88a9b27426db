import pytest

from __spark_entry__ import entry, oracle_sql, queries
from strata_checks.run import compare, connect

QUERIES, EXPECTED = queries(), oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_expected_rows(spark, sf, db, name):
    frame = QUERIES[name](spark, sf)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in EXPECTED:
        assert compare(db, EXPECTED[name], frame) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_expected_result_has_a_query():
    assert set(EXPECTED) <= set(QUERIES)
