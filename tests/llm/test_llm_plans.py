"""What the plans of the training-data queries must not contain."""

import pytest

from leadloom.llm import queries
from test_plans import plan

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_pairs(spark, name):
    """No join without a key, in the result's plan or in that of anything that a query wrote or checkpointed on its way."""
    seen = []
    tracker = spark._jsparkSession.sharedState().statusStore()
    before = tracker.executionsList().size()
    lines = plan(queries.QUERIES[name](spark, FOLDER))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = tracker.executionsList()
    for i in range(before, ran.size()):
        seen += ran.apply(i).physicalPlanDescription().splitlines()
    assert not [line for line in lines + seen if "CartesianProduct" in line or "BroadcastNestedLoopJoin" in line]
