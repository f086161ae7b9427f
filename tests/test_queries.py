"""Every registered query against its SQL on the smallest supplied tables."""

import pytest

import __spark_entry__ as entry
from panelloom.plans.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    got = frame.toPandas()
    if name in ORACLES:
        problem = compare(got, duck, ORACLES[name])
        assert problem is None, problem
    else:
        assert len(got) > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.count() == 5
    assert "instrument" in out.columns
