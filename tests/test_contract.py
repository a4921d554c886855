"""Every registered query against its SQL, and the shape of the plans."""

import pytest
from compare import actual, connect, expected

import __spark_entry__ as contract
from joblens.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, duck, name):
    assert actual(contract.queries()[name](spark, SF)) == expected(duck, contract.oracle_sql()[name])


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


STREAMS = {name for name in QUERIES if "stream" in name or name == "replay_and_tail"}
VECTORISED = {"dispatch_vectorised"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - VECTORISED))
def test_no_cross_join_and_no_python_in_batch_plans(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert word not in plan
