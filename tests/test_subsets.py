"""Layer 1 counts by class of the chain, and legacy ids."""

from pyspark.sql import functions as F

from seqlens.operators import score as S


def test_by_subset(spark):
    schema = "chain_id string, idx int, type string, state string, recover_in int, resource string"
    rows = [(c, i, kind, None, None, "x") for c, n, kind in [("a", 20, "ResourceBudget"), ("a_shuffled_7", 20, "ResourceBudget"), ("b", 30, "SubGoalTransition")] for i in range(n)]
    got = [("a", "m", 1), ("a", "m", None), ("a_shuffled_7", "m", 0), ("b", "m", 1), ("gone", "m", 1)]
    out = S.by_subset(spark.createDataFrame(got, "chain_id string, model string, l1 int"), spark.createDataFrame(rows, schema)).collect()
    counts = {(r.model, r.subset, r.value, r.condition): (r.n, r.hits) for r in out}
    assert counts == {
        ("m", "length_bucket", "short_20_25", "real"): (2, 1),
        ("m", "length_bucket", "short_20_25", "shuffled"): (1, 0),
        ("m", "length_bucket", "medium_26_32", "real"): (1, 1),
        ("m", "composition", "resource_dominated", "real"): (2, 1),
        ("m", "composition", "resource_dominated", "shuffled"): (1, 0),
        ("m", "composition", "subgoal_dominated", "real"): (1, 1),
        ("m", "archetype", "stall", "real"): (3, 2),
        ("m", "archetype", "stall", "shuffled"): (1, 0),
    }


def test_legacy_id(spark):
    df = spark.createDataFrame([("m", 42, "tb||x")], "model string, seed int, chain_id string")
    r = df.select(S.legacy_id(F.col("model"), F.col("seed"), F.col("chain_id")).alias("i")).select("i", S.from_legacy_id(F.col("i")).alias("b")).first()
    assert r.i == "m||42||tb||x" and tuple(r.b) == ("m", 42, "tb||x")
