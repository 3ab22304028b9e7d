"""Scoring joins chains with responses where the chains are dealt; nothing that grows with them is broadcast."""

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def planned(spark, name: str) -> str:
    """The physical plan as it is before it runs; tables this small would be broadcast if Spark were free to."""
    return __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()


def test_layer2_legality_broadcasts_nothing(spark):
    assert "Broadcast" not in planned(spark, "layer2_legality")


def test_layer2_optimality_broadcasts_only_the_keys_of_the_last_level(spark):
    plan = planned(spark, "layer2_optimality")
    assert plan.count("BroadcastHashJoin") <= 1 and "= 3)" in plan
