"""Distribution, scoring and statistics."""

import math
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from seqlens.functions import stats as S
from seqlens.operators import refdist as D
from seqlens.operators import score as J
from seqlens.operators import strata as X
from seqlens.schemas import CONSTRAINT_FIELDS


def constraints(spark, rows):
    """rows: (chain_id, idx, dict)."""
    names = [n for n, _ in CONSTRAINT_FIELDS]
    ddl = "chain_id string, idx int, source string, " + ", ".join(f"{n} {t}" for n, t in CONSTRAINT_FIELDS)
    return spark.createDataFrame([(c, i, "tb", *[d.get(n) for n in names]) for c, i, d in rows], ddl)


CHAIN = [
    dict(type="ResourceBudget", timestamp=1, resource="context_window", amount=0.6),
    dict(type="InformationState", timestamp=2, observable_added=["file_A"], observable_removed=[]),
    dict(type="ToolAvailability", timestamp=3, tool="command_2", state="unavailable"),
    dict(type="CoordinationDependency", timestamp=11, role="r", dependency="error_class_A"),
    dict(type="OptimizationCriterion", timestamp=12, objective="correctness_primary"),
    dict(type="OptimizationCriterion", timestamp=13, objective="correctness_second"),
    dict(type="SubGoalTransition", timestamp=25, from_phase="a", to_phase="debugging"),
    dict(type="ResourceBudget", timestamp=26, resource="context_window", amount=1.0),
    dict(type="ToolAvailability", timestamp=27, tool="command_2", state="available"),
]


def test_signature(spark):
    rows = constraints(spark, [("c", i, d) for i, d in enumerate(CHAIN)])
    got = {r.idx: r for r in D.signatures(rows).collect()}
    assert (got[0].phase_now, got[0].command_now, got[0].context_bracket, got[0].patience_bracket, got[0].turn) == ("initial", "command_unknown", 3, 4, 0)
    last = got[8]
    assert (last.phase_now, last.command_now, last.context_bracket, last.turn) == ("debugging", "command_2", 3, 2)
    assert last.status == ["file_A_revealed"] and last.field == ["correctness_second", "error_class_A_r"]
    assert D.signatures(rows, exclusive=True).filter("idx = 1").first().status == []


def test_lookup_backs_off(spark):
    base = [(f"c{k}", i, d) for k in range(3) for i, d in enumerate(CHAIN)]
    rows = constraints(spark, base)
    dist = D.build(rows)
    found = D.lookup(D.signatures(rows).withColumn("query_id", F.concat_ws("-", "chain_id", "idx")), dist).collect()
    assert all(r.level == 0 and abs(sum(e.p for e in r.entities) - 1) < 1e-9 for r in found)
    other = constraints(spark, [("z", 0, dict(type="ResourceBudget", timestamp=95, resource="context_window", amount=0.6)), ("z", 1, dict(type="SubGoalTransition", timestamp=95, to_phase="nowhere"))])
    got = {r.query_id: r for r in D.lookup(D.signatures(other).withColumn("query_id", F.col("idx")), dist).collect()}
    assert got[0].level == 2 and got[1].level == 3 and got[1].entities is None
    assert D.coverage(rows, dist).first().covered == rows.count()
    twice = D.add_observations(dist, dist)
    assert twice.agg(F.sum("cnt")).first()[0] == 2 * dist.agg(F.sum("cnt")).first()[0]


def test_layers(spark):
    rows = constraints(spark, [("c", i, d) for i, d in enumerate(CHAIN)] + [("c_shuffled_42", i, d) for i, d in enumerate(CHAIN)])
    says = [("q1", "c", 6, "Go DEBUGGING with command_2"), ("q2", "c", 6, "nothing"), ("q3", "c", 99, "x"), ("q4", "c_shuffled_42", 6, "debugging")]
    df = spark.createDataFrame([(q, c, "m", 42, 0.0, k, r) for q, c, k, r in says], "query_id string, chain_id string, model string, seed int, temperature double, cutoff_k int, response string")
    out = J.scored(df, rows, D.build(rows))
    got = {r.query_id: r for r in out.collect()}
    assert [got[q].l1 for q in ("q1", "q2", "q3", "q4")] == [1, 0, None, 1]
    assert [got[q].legality for q in ("q1", "q2")] == [0.0, 1.0]
    # steps 6 and 7 share a state, so half of its mass is caught
    assert got["q4"].optimality == 0.5 and got["q1"].coupled == 0.0 and got["q3"].source == "unknown"
    pairs = J.pairs(out.filter("query_id in ('q1', 'q4')"))
    assert pairs.select("side", "real_l1", "shuffled_l1", "shuffle_seed").collect() == [("both", 1, 1, 42)]
    assert J.paired_cells(pairs, "all").first().n11 == 1
    assert J.unpaired_bases(out.filter("query_id = 'q1'")).count() == 1
    assert J.classify_chains(rows).filter("chain_id = 'c'").first().composition == "resource_dominated"
    assert len({r.custom_id for r in J.evaluation_matrix(rows.select("chain_id").distinct(), ["a", "b"]).collect()}) == 12


@pytest.mark.parametrize("counts, want", [((64, 27, 3, 1, 1), 8438), ((1, 57, 743, 0, 0), 712)])
def test_optimality_from_counts(spark, counts, want):
    """27 of 32 is a tie at the fourth place, which summed shares miss; 57 of 800 is just below one once it is multiplied."""
    rows = constraints(spark, [("c", i, d) for i, d in enumerate(CHAIN)])
    key = D.with_levels(D.signatures(rows)).filter("idx = 6 and level = 0").first().key
    seen = [("tb", 0, key, e, n, ("c", i)) for i, (e, n) in enumerate(zip(("command_2", "file_a", "x", "y", "z"), counts, strict=True)) if n]
    dist = spark.createDataFrame(seen, "source string, level int, key string, entity string, cnt bigint, first_seen struct<chain_id:string,idx:int>")
    said = spark.createDataFrame([("q", "c", "m", 42, 0.0, 6, "open file_A")], "query_id string, chain_id string, model string, seed int, temperature double, cutoff_k int, response string")
    got = J.scored(said, rows, dist).select(*[F.round(F.col(c) * 10_000).cast("bigint") for c in ("optimality", "coupled")]).first()
    assert tuple(got) == (want, want)


def test_tiers(spark):
    cases = [(-0.02, 0.5, "reversed"), (0.01, 0.5, "null"), (0.09, 0.001, "strong_positive"), (0.06, 0.04, "moderate_positive"), (0.03, 0.2, "weak_mixed")]
    df = spark.createDataFrame([(g, p) for g, p, _ in cases], "gap double, p_value double")
    assert [r[0] for r in df.select(J.outcome_tier(F.col("gap"), F.col("p_value"))).collect()] == [t for *_, t in cases]
    cells = spark.createDataFrame([(0.0029,), (0.4360,), (0.0611,), (0.5949,)], "p_value double")
    assert [round(r.p_bonferroni, 4) for r in J.bonferroni(cells).collect()] == [0.0116, 1.0, 0.2444, 1.0]


def test_published_values():
    assert round(S.mcnemar(114, 25)["chi2"], 2) == 55.71
    assert S.mcnemar(0, 0) == {"chi2": 0.0, "p_value": 1.0} and S.mcnemar(4, 4)["chi2"] == 1 / 8
    assert abs(S.two_sided(1.959963985) - 0.05) < 1e-9
    assert abs(S.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(S.t_quantile(0.975, 10) - 2.228138852) < 1e-6
    assert abs(S.chi2_1_tail(3.841458821) - 0.05) < 1e-9
    assert abs(S.t_power(0.5, 64, 64) - 0.8015) < 1e-3 and S.t_required_n(0.5) == 64
    assert S.proportion_required_n(0.5) == 63 and abs(S.proportion_power(S.proportion_mdes(100, 100), 100, 100) - 0.8) < 1e-6
    assert abs(S.fisher_exact(8, 2, 1, 5) - 0.03497) < 1e-4
    assert abs(S.noncentral_t_cdf(1.5, 20, 0.0) - S.t_cdf(1.5, 20)) < 1e-6
    assert abs(S.entropy([0.5, 0.5]) - math.log(2)) < 1e-12
    assert S.proportion_z(0, 5, 0, 5)["z"] == 0.0 and "error" in S.proportion_z(0, 0, 1, 2) and "error" in S.welch(1, 1, 1, 1, 1, 5)
    assert math.isnan(S.paired_t(1.0, 0.0, 5)["t"])
    assert abs(S.pooled([0.1, 0.3], [0.1, 0.1])["gap"] - 0.2) < 1e-12


def test_rank_sums(spark):
    a, b = [1, 2, 2, 5, 9], [2, 3, 3, 7]
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b], "x double, one boolean")
    r = X.rank_sums(df, F.col("x"), F.col("one")).first()
    every = sorted(a + b)
    rank = lambda v: sum(i + 1 for i, x in enumerate(every) if x == v) / every.count(v)
    assert (r.n1, r.n2, r.rank_sum, r.ties) == (5, 4, sum(map(rank, a)), (27 - 3) + (8 - 2))
    u = S.mann_whitney(r.rank_sum, 5, 4, r.ties)
    assert 0 < u["p_two_sided"] <= 1 and u["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_stream(spark, tmp_path):
    from seqlens.streaming.events import by_batch

    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
    q = by_batch(stream, lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


@pytest.mark.parametrize("without", [True, False])
def test_imports_without_llm(tmp_path, without):
    """The registry imports, and has the core queries, whether or not the optional subpackage is there."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/seqlens", tmp_path / "seqlens", ignore=shutil.ignore_patterns("llm", "__pycache__") if without else None)
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'chain_validity' in q and set(e.oracle_sql()) <= set(q); print(any(k.startswith('op') for k in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip().endswith(str(not without and os.path.isdir(f"{here}/seqlens/llm")))
