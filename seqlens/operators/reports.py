"""Reports over scored results: unpaired tests, and paired tests in two variants, by four families of groups.

Spark counts; each report is a table of few cells, whose p-values are worked out cell by cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as P
from .score import condition, config, outcome_tier

FAMILIES = [["model"], ["model", "source"], ["model", "config"], ["model", "config", "source"]]
PRIMARY = ["model", "source"]


def _cells(fn, schema: str, *inputs: Column) -> Column:
    """A struct of what fn gives for a cell's numbers."""
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def of(*cols):
        import pandas as pd

        rows = [fn(*row) for row in zip(*cols, strict=True)]
        return pd.DataFrame({n: [r.get(n) for r in rows] for n in names}).astype({n: "float64" for n in names})

    return of(*[c.cast("double") for c in inputs])


def _finite(x: dict) -> dict:
    return {k: v for k, v in x.items() if isinstance(v, float | int) and math.isfinite(v)}


def z_test(h1: float, n1: float, h2: float, n2: float) -> dict:
    got = P.proportion_z(int(h1), int(n1), int(h2), int(n2))
    return {k: got[k] for k in ("gap", "z", "p_value")} if "error" not in got else {}


def t_test(m1: float, v1: float, n1: float, m2: float, v2: float, n2: float) -> dict:
    return _finite(P.welch(m1, v1, int(n1), m2, v2, int(n2)))


def mcnemar_test(b: float, c: float) -> dict:
    return P.mcnemar(int(b), int(c))


def paired_t_test(mean: float, sd: float, n: float) -> dict:
    return _finite(P.paired_t(mean, sd, int(n)))


def _grouped(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Cells of all families; -- stands for all, family names what is told apart."""
    out = df.groupingSets(FAMILIES, "model", "source", "config").agg(F.grouping_id().alias("__g"), *aggregates)
    name = F.concat_ws("_", F.lit("model"), F.when(F.col("__g").bitwiseAND(1) == 0, "config"), F.when(F.col("__g").bitwiseAND(2) == 0, "source"))
    return out.withColumn("family", name).drop("__g").fillna("--", ["source", "config"])


def _tier(gap: str, p: str) -> Column:
    """From what is rounded to four places; a cell without a test has no gap and p = 1."""
    return outcome_tier(F.coalesce(F.round(gap, 4), F.lit(0.0)), F.coalesce(F.round(p, 4), F.lit(1.0)))


def unpaired_report(scored: DataFrame) -> DataFrame:
    """Each family's cells with the z-test of layer 1 (all, and each side's actionable results) and Welch's test of layer 2."""
    df = scored.withColumn("config", config()).withColumn("real", condition() == "real")
    known = F.col("l1").isNotNull()
    aggregates = []
    for side, on in (("real", F.col("real")), ("shuffled", ~F.col("real"))):
        for name, which in (("", known), ("act_", known & F.col("actionable"))):
            aggregates += [F.count_if(on & which).alias(f"{name}n_{side}"), F.coalesce(F.sum(F.when(on & which, F.col("l1"))), F.lit(0)).alias(f"{name}hits_{side}")]
        value = F.when(on, F.col("coupled"))
        aggregates += [F.avg(value).alias(f"l2_mean_{side}"), F.var_samp(value).alias(f"l2_var_{side}"), F.count(value).alias(f"l2_n_{side}")]
    cells = _grouped(df, *aggregates)
    col = F.col
    cells = cells.withColumn("l1", _cells(z_test, "gap double, z double, p_value double", *[col(f"{x}_{s}") for s in ("real", "shuffled") for x in ("hits", "n")]))
    cells = cells.withColumn("act", _cells(z_test, "gap double, z double, p_value double", *[col(f"act_{x}_{s}") for s in ("real", "shuffled") for x in ("hits", "n")]))
    cells = cells.withColumn("l2", _cells(t_test, "t double, p_value double, ci_low double, ci_high double", *[col(f"l2_{x}_{s}") for s in ("real", "shuffled") for x in ("mean", "var", "n")]))
    return cells.withColumn("tier", _tier("act.gap", "act.p_value"))


def type_report(scored: DataFrame) -> DataFrame:
    """Layer 1 by type of the constraint asked for: counts, rates, gap with its interval, z and p."""
    real, known = condition() == "real", F.col("l1").isNotNull()
    sides = (("real", real), ("shuffled", ~real))
    counted = [f for s, on in sides for f in (F.count_if(on).alias(f"n_{s}"), F.coalesce(F.sum(F.when(on, F.col("l1"))), F.lit(0)).alias(f"hits_{s}"))]
    cells = scored.filter(known).groupBy("model", "source", "gt_type").agg(*counted)
    return with_interval(cells).withColumn("test", _cells(z_test, "gap double, z double, p_value double", *[F.col(f"{x}_{s}") for s in ("real", "shuffled") for x in ("hits", "n")]))


def with_interval(cells: DataFrame, z: float = 1.96) -> DataFrame:
    """Rates, gap and its unpooled interval from n_* and hits_*; null where a side is empty."""
    both = (F.col("n_real") > 0) & (F.col("n_shuffled") > 0)
    rate = {s: F.when(F.col(f"n_{s}") > 0, F.col(f"hits_{s}") / F.col(f"n_{s}")) for s in ("real", "shuffled")}
    df = cells.select("*", *[F.when(both, c).alias(f"{s}_rate") for s, c in rate.items()]).withColumn("gap", F.col("real_rate") - F.col("shuffled_rate"))
    se = F.sqrt(sum(F.col(f"{s}_rate") * (1 - F.col(f"{s}_rate")) / F.col(f"n_{s}") for s in rate))
    return df.withColumn("gap_low", F.col("gap") - z * se).withColumn("gap_high", F.col("gap") + z * se)


def paired_report(aligned: DataFrame, actionable: str = "both") -> DataFrame:
    """Each family's cells of paired results with McNemar's test (all, and those actionable on the real side or on both) and the
    paired t-test of layer 2, p-values by Bonferroni over the primary cells and over all, and tiers."""
    df = aligned.filter("side = 'both'").withColumn("source", F.col("real_source"))
    df = df.withColumn("config", F.concat(F.lit("T"), F.col("real_temperature").cast("string"), F.lit("_seed"), F.col("seed").cast("string")))
    known = F.col("real_l1").isNotNull() & F.col("shuffled_l1").isNotNull()
    rule = known & F.col("real_actionable") & (F.col("shuffled_actionable") if actionable == "both" else F.lit(True))
    aggregates = []
    for name, on in (("", known), ("act_", rule)):
        for cell, r, s in (("n11", 1, 1), ("b", 1, 0), ("c", 0, 1), ("n00", 0, 0)):
            aggregates.append(F.count_if(on & (F.col("real_l1") == r) & (F.col("shuffled_l1") == s)).alias(f"{name}{cell}"))
        aggregates.append(F.count_if(on).alias(f"{name}n"))
    diff = F.col("real_coupled") - F.col("shuffled_coupled")
    aggregates += [F.avg(diff).alias("l2_gap"), F.stddev_samp(diff).alias("l2_sd"), F.count(diff).alias("l2_n")]
    cells = _grouped(df, *aggregates)
    for name in ("", "act_"):
        cells = cells.withColumn(f"{name}test", F.when(F.col(f"{name}n") > 0, _cells(mcnemar_test, "chi2 double, p_value double", F.col(f"{name}b"), F.col(f"{name}c"))))
        cells = cells.withColumn(f"{name}gap", F.when(F.col(f"{name}n") > 0, (F.col(f"{name}b") - F.col(f"{name}c")) / F.col(f"{name}n")))
    cells = cells.withColumn("l2", _cells(paired_t_test, "t double, p_value double", F.col("l2_gap"), F.col("l2_sd"), F.col("l2_n")))
    return with_bonferroni(cells.withColumn("p", F.coalesce(F.round("act_test.p_value", 4), F.lit(1.0))))


def with_bonferroni(cells: DataFrame) -> DataFrame:
    """p, rounded already, times the number of primary cells (for those) and of all cells; thresholds and tiers."""
    from pyspark.sql import Window

    every = Window.partitionBy()  # cells of a report are few
    primary = F.col("family") == "_".join(PRIMARY)
    n_primary, n_full = F.count_if(primary).over(every), F.count("*").over(every)
    df = cells.withColumn("p_full", F.least(F.lit(1.0), F.col("p") * n_full)).withColumn("p_primary", F.when(primary, F.least(F.lit(1.0), F.col("p") * n_primary)))
    gap = F.round("act_gap", 4)
    df = df.withColumn("meets", F.coalesce((gap >= 0.05) & (F.col("p_primary") < 0.05), F.lit(False))).withColumn("meets_uncorrected", F.coalesce(primary & (gap >= 0.05) & (F.col("p") < 0.05), F.lit(False)))
    df = df.withColumn("tier", _tier("act_gap", "p")).withColumn("tier_bonferroni", F.when(primary, _tier("act_gap", "p_primary")))
    return df.withColumn("minimum_met", F.bool_or("meets").over(every))


def power_report(cells: DataFrame) -> DataFrame:
    """Of cells with n_real, n_shuffled, real_rate, shuffled_rate, gap, t (layer 2): effect sizes, power, smallest effects that
    would be found, and numbers that would be needed."""

    def layer1(n1, n2, p1, p2, gap):
        h, least = P.cohens_h(p1, p2), P.cohens_h(min(1.0, p2 + 0.05), p2)
        need = lambda x: P.proportion_required_n(abs(x), ratio=n2 / n1)
        return {"h": h, "power": P.proportion_power(h, n1, n2), "mdes": P.proportion_mdes(n1, n2), "needed": need(h) if gap > 0 else -1, "needed_threshold": need(least)}

    def layer2(n1, n2, t):
        d = abs(P.d_from_t(t, n1, n2))
        return {"d": d, "power": P.t_power(d, n1, n2)}

    col = F.col
    df = cells.withColumn("layer1", _cells(layer1, "h double, power double, mdes double, needed double, needed_threshold double", *map(col, ("n_real", "n_shuffled", "real_rate", "shuffled_rate", "gap"))))
    return df.withColumn("layer2", _cells(layer2, "d double, power double", col("n_real"), col("n_shuffled"), col("t")))


def compression_report(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Of cells (model, source, n_real, n_shuffled, real_rate, shuffled_rate, gap): the difference of two models' gaps in each
    source, and pooled by inverse variance (source --), with z and p."""
    pooled = (col_rate("real") + col_rate("shuffled")) / (F.col("n_real") + F.col("n_shuffled"))
    se2 = pooled * (1 - pooled) * (1 / F.col("n_real") + 1 / F.col("n_shuffled"))
    side = lambda m, x: F.max(F.when(F.col("model") == m, x))
    df = cells.withColumn("se2", se2).groupBy("source").agg((side(first, F.col("gap")) - side(second, F.col("gap"))).alias("difference"), (side(first, F.col("se2")) + side(second, F.col("se2"))).alias("v"))
    df = df.filter("difference is not null")
    whole = df.agg((F.sum(F.col("difference") / F.col("v")) / F.sum(1 / F.col("v"))).alias("difference"), (1 / F.sum(1 / F.col("v"))).alias("v"))
    both = df.unionByName(whole.withColumn("source", F.lit("--")))
    both = both.withColumn("z", F.when(F.col("v") > 0, F.col("difference") / F.sqrt("v")).otherwise(0.0)).drop("v")
    return both.withColumn("p_value", _cells(lambda z: {"p": P.two_sided(z)}, "p double", F.col("z"))["p"])


def col_rate(side: str) -> Column:
    return F.col(f"{side}_rate") * F.col(f"n_{side}")
