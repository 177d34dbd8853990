"""Joins of op3's tables, which grow with the vectors and are small on disk only, are not by broadcast: the driver builds what is sent so."""

import numpy as np

from marlstone.llm.vectors import near


def _plans(spark) -> dict[int, str]:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(k).executionId(): found.apply(k).physicalPlanDescription() for k in range(found.size())}


def test_nothing_that_grows_is_broadcast(spark):
    """At Spark's own limit for broadcasts, beside which these tables are tiny."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(7 * k, (base[k % 40] + 0.001 * rng.standard_normal(16)).tolist(), k % 2) for k in range(160)]
    before = _plans(spark)
    found = near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["n_links"] for r in found} == {3} and sum(r["kept"] for r in found) == 40
    made = [plan for k, plan in _plans(spark).items() if k not in before]
    assert any("SortMergeJoin" in plan for plan in made)
    assert not [plan for plan in made if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan]
