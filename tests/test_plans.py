"""Plan lint over every registered query (sf0.001): no Cartesian products, no
nested-loop joins, no row-at-a-time Python UDFs; scans are column-pruned."""

import pytest

import __spark_entry__ as E
from conftest import SF001

SLOW = {"rf_score", "model_leaderboard", "best_model", "gbt_score", "rff_score"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in E.queries() if k not in SLOW))
def test_plan_shape(spark, key):
    plan = _plan(E.queries()[key](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan          # row-at-a-time Python UDF
    # lineitem / orders scans never read every column for these projections
    for line in plan.splitlines():
        if "FileScan parquet" in line and "lineitem.parquet" in line:
            assert "l_shipdate" not in line or "l_quantity" not in line or key in ("dedupe",)
