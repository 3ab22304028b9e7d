"""Queries of reports and statistics over results, with oracle SQL that works out p-values by other formulas.

Each document stands for a result: every fourth is a real chain, the three after it are its shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as P
from ..operators import reports as R
from ..operators import score as S
from ..operators import strata as A
from ..sources import files as X
from . import sql as Q
from .adapters import table
from .queries import _RESP, _chain_rows, _dist, _scored
from .source_queries import fresh

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def erfc(x: str) -> str:
    """SQL of the complementary error function for x >= 0 by Simpson's rule."""
    w = "(case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 401), lambda i: {w} * exp(-power(({x}) * i / 400.0, 2)))) * ({x}) / 1200.0)"


def erfc_near(x: str) -> str:
    """The same without a lambda, to seven places (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + 0.3275911 * ({x})))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x})))"


def p_two(z: str) -> str:
    return erfc(f"(abs({z}) / sqrt(2.0))")


def phi(x: str) -> str:
    tail = erfc_near(f"(abs({x}) / sqrt(2.0))")
    return f"(case when {x} >= 0 then 1 - {tail} / 2 else {tail} / 2 end)"


def t_two(t: str, v: str) -> str:
    """SQL of the two-sided p of Student's t by Simpson's rule."""
    c = f"exp(lgamma((({v}) + 1) / 2.0) - lgamma(({v}) / 2.0)) / sqrt(({v}) * pi())"
    w = "(case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end)"
    area = f"list_sum(list_transform(range(0, 1001), lambda i: {w} * power(1 + power(abs({t}) * i / 1000.0, 2) / ({v}), -(({v}) + 1) / 2.0))) * abs({t}) / 3000.0"
    return f"(1 - 2 * {c} * {area})"


def t_quantile(v: str) -> str:
    """SQL of the upper 2.5 % point of Student's t, by its expansion around the normal one and a step of Newton's method."""
    z = 1.959963984540054
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3, g4 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    q = f"({z} + {g1} / ({v}) + {g2} / power({v}, 2) + {g3} / power({v}, 3) + {g4} / power({v}, 4))"
    density = f"(exp(lgamma((({v}) + 1) / 2.0) - lgamma(({v}) / 2.0)) / sqrt(({v}) * pi()) * power(1 + power({q}, 2) / ({v}), -(({v}) + 1) / 2.0))"
    return f"({q} + ({t_two(q, v)} - 0.05) / (2 * {density}))"


def parts(c: str, name: str, of: int = 10_000) -> str:
    return f"cast(round(({c}) * {of}) as bigint) as {name}"


def scaled(c, name: str, of: int = 10_000):
    return F.round((F.col(c) if isinstance(c, str) else c) * of).cast("bigint").alias(name)


_TYPES = list(A.CARRIERS)
_R = f"""r as (select doc_id, doc_id // 4 as base, doc_id % 4 as v, 'm' || ((doc_id // 4) % 2) as model, 's' || ((doc_id // 8) % 2) as source, case when (doc_id // 4) % 3 = 0 then '0.7' else '0.0' end as t,
    'T' || t || '_seed42' as config, case when n_chars % 11 = 0 then null else cast(n_chars % 3 = 0 or (doc_id % 4 = 0 and n_chars % 5 = 0) as int) end as l1,
    {_TYPES}[doc_id % 5 + 1] as gt, doc_id % 5 in (1, 2, 3) as act, cast(n_chars % 100 as double) / 100 as coupled from documents)"""


def results(spark, d) -> DataFrame:
    df = table(spark, d, "documents")
    base, v, n = F.floor(F.col("doc_id") / 4), F.col("doc_id") % 4, F.col("n_chars")
    cid = F.concat(F.lit("c"), base.cast("string"))
    right = (n % 3 == 0) | ((v == 0) & (n % 5 == 0))
    gt = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % 5).cast("int") + 1)
    return df.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("query_id"),
        F.when(v == 0, cid).otherwise(F.concat(cid, F.lit("_shuffled_"), v.cast("string"))).alias("chain_id"),
        F.concat(F.lit("m"), (base % 2).cast("string")).alias("model"), F.concat(F.lit("s"), (F.floor(F.col("doc_id") / 8) % 2).cast("string")).alias("source"),
        F.lit(42).alias("seed"), F.when(base % 3 == 0, 0.7).otherwise(0.0).alias("temperature"), F.when(n % 11 != 0, right.cast("int")).alias("l1"),
        gt.alias("gt_type"), gt.isin(*S.ACTIONABLE).alias("actionable"), ((n % 100).cast("double") / 100).alias("coupled"),
    )


_SETS = "grouping sets ((model), (model, source), (model, config), (model, source, config))"
_NAMES = "model, coalesce(source, '--') as source, coalesce(config, '--') as config"
_FAMILY = "case when source = '--' then case when config = '--' then 'model' else 'model_config' end when config = '--' then 'model_source' else 'model_config_source' end as family"
_TIER = """case when {g} < -0.01 then 'reversed' when abs({g}) < 0.02 and {p} > 0.1 then 'null' when {g} >= 0.08 and {p} < 0.01 then 'strong_positive'
  when {g} >= 0.05 and {p} < 0.05 then 'moderate_positive' else 'weak_mixed' end"""


def _z(h1: str, n1: str, h2: str, n2: str) -> str:
    """SQL of (gap, z) columns' parts."""
    pool = f"(({h1} + {h2}) / ({n1} + {n2}))"
    return f"(case when {pool} * (1 - {pool}) > 0 then ({h1} / {n1} - {h2} / {n2}) / sqrt({pool} * (1 - {pool}) * (1.0 / {n1} + 1.0 / {n2})) else 0 end)"


_UNPAIRED = f"""with {_R}, g as (select {_NAMES},
    count(l1) filter (where v = 0) as n1, coalesce(sum(l1) filter (where v = 0), 0)::double as h1, count(l1) filter (where v > 0) as n2, coalesce(sum(l1) filter (where v > 0), 0)::double as h2,
    count(l1) filter (where v = 0 and act) as an1, coalesce(sum(l1) filter (where v = 0 and act), 0)::double as ah1, count(l1) filter (where v > 0 and act) as an2, coalesce(sum(l1) filter (where v > 0 and act), 0)::double as ah2,
    avg(coupled) filter (where v = 0) as m1, var_samp(coupled) filter (where v = 0) / count(*) filter (where v = 0) as a, count(*) filter (where v = 0) as k1,
    avg(coupled) filter (where v > 0) as m2, var_samp(coupled) filter (where v > 0) / count(*) filter (where v > 0) as b, count(*) filter (where v > 0) as k2
  from r group by {_SETS}),
z as (select *, {_z("h1", "n1", "h2", "n2")} as z, {_z("ah1", "an1", "ah2", "an2")} as az, (m1 - m2) / sqrt(a + b) as tt, power(a + b, 2) / (a * a / (k1 - 1) + b * b / (k2 - 1)) as df,
    round(ah1 / an1 - ah2 / an2, 4) as ag from g),
p as (select *, {p_two("z")} as pz, round({p_two("az")}, 4) as paz, {t_two("tt", "df")} as pt from z)"""


@query("score_report_v0", f"""{_UNPAIRED} select {_FAMILY}, model, source, config, n1 as n_real, n2 as n_shuffled, {parts("h1 / n1 - h2 / n2", "gap")}, {parts("z", "z")}, {parts("pz", "p")},
    an1 as act_n_real, an2 as act_n_shuffled, {parts("ag", "act_gap")}, {parts("paz", "act_p")}, {parts("m1 - m2", "l2_gap")}, {parts("tt", "t", 1000)}, {parts("pt", "l2_p", 1000)},
    {parts(f"m1 - {t_quantile('k1 - 1')} * sqrt(a)", "ci_low", 1000)}, {parts(f"m1 + {t_quantile('k1 - 1')} * sqrt(a)", "ci_high", 1000)}, {_TIER.format(g="ag", p="paz")} as tier from p""")  # fmt: skip
def score_report_v0(spark, d):
    """Unpaired: two-sample z of layer 1, Welch's t of layer 2."""
    out = R.unpaired_report(results(spark, d))
    return out.select(
        "family", "model", "source", "config", "n_real", "n_shuffled", scaled("l1.gap", "gap"), scaled("l1.z", "z"), scaled("l1.p_value", "p"),
        "act_n_real", "act_n_shuffled", scaled("act.gap", "act_gap"), scaled("act.p_value", "act_p"), scaled(F.col("l2_mean_real") - F.col("l2_mean_shuffled"), "l2_gap"),
        scaled("l2.t", "t", 1000), scaled("l2.p_value", "l2_p", 1000), scaled("l2.ci_low", "ci_low", 1000), scaled("l2.ci_high", "ci_high", 1000), "tier",
    )


def _paired(rule: str) -> str:
    cells = ", ".join(f"count(*) filter (where {on} and x.l1 = {r} and y.l1 = {s}) as {n}{c}" for n, on in (("", "known"), ("a", f"known and {rule}")) for c, r, s in (("n11", 1, 1), ("b", 1, 0), ("c", 0, 1), ("n00", 0, 0)))
    chi = lambda n: f"(case when {n}b + {n}c = 0 then 0 else power(abs({n}b - {n}c) - 1, 2) / ({n}b + {n}c) end)"
    return f"""with {_R}, j as (select x.model, x.source, x.config, x.l1 as xl, y.l1 as yl, x.act as xa, y.act as ya, x.coupled - y.coupled as diff, x.l1 is not null and y.l1 is not null as known, x.l1 as l1x
    from (select * from r where v = 0) x join (select * from r where v > 0) y using (base)),
g as (select {_NAMES}, {cells.replace("x.l1", "xl").replace("y.l1", "yl")}, avg(diff) as m, stddev_samp(diff) as sd, count(*) as k from j group by {_SETS}),
c as (select *, an11 + ab + ac + an00 as an, n11 + b + c + n00 as n, {chi("")} as chi, {chi("a")} as achi, m / (sd / sqrt(k)) as tt from g),
p as (select *, {_FAMILY}, case when chi > 0 then {erfc("sqrt(chi / 2)")} else 1 end as pc, round(case when an = 0 then 1 when achi > 0 then {erfc("sqrt(achi / 2)")} else 1 end, 4) as pa, {t_two("tt", "(k - 1)")} as pt,
  round((ab - ac) / an, 4) as ag from c),
q as (select *, least(1, pa * count(*) over ()) as pf, case when family = 'model_source' then least(1, pa * count(*) filter (where family = 'model_source') over ()) end as pp from p)
select family, model, source, config, n11, b, c, n00, {parts("chi", "chi", 1000)}, {parts("pc", "p", 1000)}, an as act_n, {parts("ag", "act_gap")}, {parts("pa", "act_p", 1000)}, {parts("m", "l2_gap")}, {parts("tt", "t", 1000)}, {parts("pt", "l2_p", 1000)},
  {parts("pf", "p_full", 1000)}, {parts("pp", "p_primary", 1000)}, coalesce(ag >= 0.05 and pp < 0.05, false) as meets, coalesce(family = 'model_source' and ag >= 0.05 and pa < 0.05, false) as meets_uncorrected,
  {_TIER.format(g="ag", p="pa")} as tier, case when family = 'model_source' then {_TIER.format(g="ag", p="pp")} end as tier_bonferroni, bool_or(coalesce(ag >= 0.05 and pp < 0.05, false)) over () as minimum_met from q"""


def _paired_report(spark, d, rule: str) -> DataFrame:
    out = R.paired_report(S.pairs(results(spark, d)), rule)
    return out.select(
        "family", "model", "source", "config", "n11", "b", "c", "n00", scaled("test.chi2", "chi", 1000), scaled("test.p_value", "p", 1000), "act_n", scaled(F.round("act_gap", 4), "act_gap"),
        scaled(F.col("p"), "act_p", 1000), scaled("l2_gap", "l2_gap"), scaled("l2.t", "t", 1000), scaled("l2.p_value", "l2_p", 1000), scaled("p_full", "p_full", 1000), scaled("p_primary", "p_primary", 1000),
        "meets", "meets_uncorrected", "tier", "tier_bonferroni", "minimum_met",
    )


@query("score_report_v1", _paired("xa"))
def score_report_v1(spark, d):
    """Paired, actionable on the real side."""
    return _paired_report(spark, d, "real")


@query("score_report_v2", _paired("xa and ya"))
def score_report_v2(spark, d):
    """Paired, actionable on both sides."""
    return _paired_report(spark, d, "both")


_KEYED = """k as (select doc_id // 8 as base, doc_id % 8 as v, case when doc_id % 8 < 3 then doc_id % 8 else (doc_id * 5) % 3 end as seed, case when doc_id % 8 < 3 then null when doc_id % 8 < 6 then 42 else 7 end as shuffle, n_chars % 2 as l1, doc_id from documents)"""


@query("pair_sides", f"""with {_KEYED}, x as (select * from k where v < 3 and doc_id % 5 > 0), y as (select base, seed, shuffle, arg_max(l1, doc_id) as l1 from k where v > 2 and base in (select base from x) group by all),
  w as (select distinct base, shuffle from y), a as (select x.*, w.shuffle as variant from x left join w using (base))
  select 'c' || coalesce(a.base, y.base) as base_id, coalesce(a.variant, y.shuffle) as shuffle_seed, coalesce(a.seed, y.seed) as seed,
    case when a.base is null then 'shuffled_only' when y.base is null then 'real_only' else 'both' end as side, a.l1 as real_l1, y.l1 as shuffled_l1
  from a full join y on a.base = y.base and a.variant = y.shuffle and a.seed = y.seed""")  # fmt: skip
def pair_sides(spark, d):
    """Results of a seed that one side lacks count for each shuffle."""
    df = table(spark, d, "documents").withColumn("v", F.col("doc_id") % 8)
    base = F.concat(F.lit("c"), F.floor(F.col("doc_id") / 8).cast("string"))
    real = F.col("v") < 3
    cid = F.when(real, base).otherwise(F.concat(base, F.lit("_shuffled_"), F.when(F.col("v") < 6, "42").otherwise("7")))
    df = df.filter(~real | (F.col("doc_id") % 5 > 0)).select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("query_id"), cid.alias("chain_id"), F.lit("m").alias("model"), F.when(real, F.col("v")).otherwise((F.col("doc_id") * 5) % 3).alias("seed"),
        F.lit("s").alias("source"), F.lit(0.0).alias("temperature"), (F.col("n_chars") % 2).alias("l1"), F.lit(True).alias("actionable"), F.lit("t").alias("gt_type"),
    )
    return S.pairs(df).select("base_id", "shuffle_seed", "seed", "side", "real_l1", "shuffled_l1")


_CI = "1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)"
_TYPE_CELLS = f"""with {_R}, g as (select model, source, gt, count(l1) filter (where v = 0) as n1, count(l1) filter (where v > 0) as n2, coalesce(sum(l1) filter (where v = 0), 0)::double as h1, coalesce(sum(l1) filter (where v > 0), 0)::double as h2
    from r where l1 is not null group by all),
  c as (select *, h1 / n1 as p1, h2 / n2 as p2, {_z("h1", "n1", "h2", "n2")} as z from g)"""


@query("type_strata", f"{_TYPE_CELLS} select model, source, gt as gt_type, n1 as n_real, n2 as n_shuffled, {parts('p1', 'real_rate')}, {parts('p2', 'shuffled_rate')}, {parts('p1 - p2', 'gap')}, {parts('z', 'z')}, {parts(p_two('z'), 'p')},"
       f" {parts(f'p1 - p2 - {_CI}', 'gap_low', 1000)}, {parts(f'p1 - p2 + {_CI}', 'gap_high', 1000)} from c")  # fmt: skip
def type_strata(spark, d):
    out = R.type_report(results(spark, d))
    return out.select(
        "model", "source", "gt_type", "n_real", "n_shuffled", scaled("real_rate", "real_rate"), scaled("shuffled_rate", "shuffled_rate"), scaled("gap", "gap"), scaled("test.z", "z"), scaled("test.p_value", "p"),
        scaled("gap_low", "gap_low", 1000), scaled("gap_high", "gap_high", 1000),
    )


@query("subset_strata", Q.sql(_RESP, """, k as (select task_id, case when n <= 25 then 'short_20_25' when n <= 32 then 'medium_26_32' else 'long_33_40' end as length_bucket,
      case when r > s then 'resource_dominated' when s > r then 'subgoal_dominated' else 'balanced' end as composition, case when g >= 4 then 'aggressive' else 'stall' end as archetype
    from (select task_id, count(*) as n, count(*) filter (where ctype = 'ResourceBudget') as r, count(*) filter (where ctype = 'SubGoalTransition') as s,
      count(*) filter (where ctype = 'ToolAvailability' and state = 'unavailable' and recover_in is null) as g from chain group by task_id)),
  e as (select model, unnest(['length_bucket', 'composition', 'archetype']) as subset, unnest([length_bucket, composition, archetype]) as value, coalesce(l1, 0) as l1 from sc join k using (task_id))
  select model, subset, value, count(*) as n_real, cast(sum(l1) as bigint) as hits_real, cast(round(10000 * sum(l1) / count(*)) as bigint) as real_rate, null::bigint as gap from e group by all""".replace(", k as (", " , k as (", 1)).replace("\n ,", ",\n"))  # fmt: skip
def subset_strata(spark, d):
    """Rates by class of the chain; without shuffled results there is no gap."""
    cells = S.by_subset(_scored(spark, d), _chain_rows(spark, d))
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("condition") == s, F.col(c))), F.lit(0))
    wide = cells.groupBy("model", "subset", "value").agg(*[side(s, c).alias(f"{c}_{s}") for s in ("real", "shuffled") for c in ("n", "hits")])
    df = R.with_interval(wide)
    return df.select("model", "subset", "value", "n_real", "hits_real", scaled(F.col("hits_real") / F.col("n_real"), "real_rate"), scaled("gap", "gap"))


_PS = "(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)))"
_SHIFT = "(abs(h) / sqrt(1.0 / n1 + 1.0 / n2))"
_NEED = "ceil(power((1.959963984540054 + 0.8416212335729143) / {h}, 2) * (1 + n1 / n2::double))"
_PRIMARY_CELLS = f"""with {_R}, g as (select model, source, count(l1) filter (where v = 0) as n1, count(l1) filter (where v > 0) as n2, sum(l1) filter (where v = 0)::double as h1, sum(l1) filter (where v > 0)::double as h2,
    avg(coupled) filter (where v = 0) as m1, avg(coupled) filter (where v > 0) as m2, var_samp(coupled) filter (where v = 0) / count(*) filter (where v = 0) as a, var_samp(coupled) filter (where v > 0) / count(*) filter (where v > 0) as b from r group by all),
  c as (select *, h1 / n1 as p1, h2 / n2 as p2, (m1 - m2) / sqrt(a + b) as tt from g)"""
_W = "(case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end)"


@query("power_cells", f"""{_PRIMARY_CELLS}, e as (select *, {_PS} as h, abs(2 * asin(sqrt(least(1, p2 + 0.05))) - 2 * asin(sqrt(p2))) as h5, abs(tt) * sqrt(1.0 / n1 + 1.0 / n2) as dd, n1 + n2 - 2 as v from c),
  f as (select *, {_SHIFT} as shift, {t_quantile("v")} as crit, dd / sqrt(1.0 / n1 + 1.0 / n2) as delta, 8 / sqrt(2.0 * v) as reach from e)
  select model, source, {parts("h", "h")}, {parts(f"1 - {phi('(1.959963984540054 - shift)')} + {phi('(-1.959963984540054 - shift)')}", "power", 1000)}, {parts("(1.959963984540054 + 0.8416212335729143) * sqrt(1.0 / n1 + 1.0 / n2)", "mdes", 1000)},
    cast(case when p1 > p2 then {_NEED.format(h="h")} else -1 end as bigint) as needed, cast({_NEED.format(h="h5")} as bigint) as needed_threshold, {parts("dd", "d")},
    {parts(f'''list_sum(list_transform(range(0, 401), lambda i: {_W} * exp(ln(2.0) + v / 2.0 * ln(v / 2.0) - lgamma(v / 2.0) + (v - 1) * ln(1 - reach + i * reach / 200) - v * power(1 - reach + i * reach / 200, 2) / 2)
      * (1 - {phi("(crit * (1 - reach + i * reach / 200) - delta)")} + {phi("(-crit * (1 - reach + i * reach / 200) - delta)")}))) * reach / 600''', "l2_power", 1000)} from f""")  # fmt: skip
def power_cells(spark, d):
    """Power, least effects and numbers needed of the primary cells."""
    cells = R.with_interval(R.unpaired_report(results(spark, d)).filter("family = 'model_source'")).withColumn("t", F.col("l2.t"))
    out = R.power_report(cells.drop("l1", "l2"))
    whole = lambda c: F.col(c).cast("bigint").alias(c.split(".")[1])
    return out.select(
        "model", "source", scaled("layer1.h", "h"), scaled("layer1.power", "power", 1000), scaled("layer1.mdes", "mdes", 1000), whole("layer1.needed"), whole("layer1.needed_threshold"),
        scaled("layer2.d", "d"), scaled("layer2.power", "l2_power", 1000),
    )


@query("gap_compression", f"""{_PRIMARY_CELLS}, s as (select *, (h1 + h2) / (n1 + n2) as pool from c), w as (select *, pool * (1 - pool) * (1.0 / n1 + 1.0 / n2) as v from s),
  j as (select x.source, (x.p1 - x.p2) - (y.p1 - y.p2) as d, x.v + y.v as v from (select * from w where model = 'm0') x join (select * from w where model = 'm1') y using (source)),
  k as (select * from j union all select '--', sum(d / v) / sum(1 / v), 1 / sum(1 / v) from j)
  select source, {parts("d", "difference")}, {parts("d / sqrt(v)", "z", 1000)}, {parts(p_two("d / sqrt(v)"), "p", 1000)} from k""")  # fmt: skip
def gap_compression(spark, d):
    cells = R.with_interval(R.unpaired_report(results(spark, d)).filter("family = 'model_source'").drop("l1", "l2"))
    return R.compression_report(cells, "m0", "m1").select("source", scaled("difference", "difference"), scaled("z", "z", 1000), scaled("p_value", "p", 1000))


_LOG = "(lgamma(r1 + 1.0) - lgamma({x} + 1.0) - lgamma(r1 - {x} + 1.0) + lgamma(r2 + 1.0) - lgamma(c1 - {x} + 1.0) - lgamma(r2 - c1 + {x} + 1.0) - lgamma(r1 + r2 + 1.0) + lgamma(c1 + 1.0) + lgamma(r1 + r2 - c1 + 1.0))"


@query("carrier_types", f"""{_TYPE_CELLS}, k as (select model, source, arg_max(gt, p1 - p2) filter (where n1 >= 10) as carrier, cast(round_even(sum(case when gt = 'InformationState' then round(p1, 4) * n1 else 0 end), 0) as bigint) as t,
    cast(sum(case when gt <> 'InformationState' and n1 >= 10 and p1 > p2 then round_even(round(p1 - p2, 4) * n1, 0) else 0 end) as bigint) as o from c group by all),
  w as (select model, max(carrier) filter (where source = 's0') as carrier0, max(carrier) filter (where source = 's1') as carrier1, max(t) filter (where source = 's0') as a, max(t) filter (where source = 's1') as b,
    max(o) filter (where source = 's0') as c, max(o) filter (where source = 's1') as d from k group by model),
  m as (select *, a + b as r1, c + d as r2, a + c as c1 from w)
  select model, carrier0, carrier1, carrier0 <> carrier1 as differs, a, b, c, d, {parts(f'''list_sum(list_transform(range(greatest(0, c1 - r2), least(r1, c1) + 1),
    lambda x: case when {_LOG.format(x="x")} <= {_LOG.format(x="a")} + 1e-7 then exp({_LOG.format(x="x")}) else 0 end))''', "p", 1000)} from m""")  # fmt: skip
def carrier_types(spark, d):
    """The type that carries the gap in each source, and Fisher's test of the tested type against the others."""
    cells = R.type_report(results(spark, d))
    hits = A.carrier_table(cells).join(A.carrier(cells).select("model", "source", "carrier"), ["model", "source"], "left")
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    df = hits.groupBy("model").agg(
        of("s0", "carrier").alias("carrier0"), of("s1", "carrier").alias("carrier1"), of("s0", "tested_hits").alias("a"), of("s1", "tested_hits").alias("b"), of("s0", "other_hits").alias("c"), of("s1", "other_hits").alias("d")
    )
    df = A.with_p_values(df, lambda a, b, c, d: P.fisher_exact(int(a), int(b), int(c), int(d)), ["a", "b", "c", "d"], "p")
    return df.select("model", "carrier0", "carrier1", (F.col("carrier0") != F.col("carrier1")).alias("differs"), "a", "b", "c", "d", scaled("p", "p", 1000))


@query("mann_whitney_p", f"""with x as (select n_chars % 500 as y, doc_id % 2 = 0 as a from documents), t as (select y, count(*) as t, count(*) filter (where a) as na from x group by y),
  k as (select *, sum(t) over (order by y) - t + (t + 1) / 2.0 as rk from t),
  s as (select sum(na) as n1, sum(t - na) as n2, sum(rk * na) as r, sum(power(t::double, 3) - t) as ties from k),
  u as (select *, r - n1 * (n1 + 1) / 2.0 as u, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) as sd from s)
  select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, cast(round(2 * u) as bigint) as u2, {parts(f"least(1, 2 * (1 - {phi('((abs(u - n1 * n2 / 2.0) - 0.5) / sd)')}))", "p_two", 1000)}, {parts(f"1 - {phi('((u - n1 * n2 / 2.0 - 0.5) / sd)')}", "p_greater", 1000)} from u""")  # fmt: skip
def mann_whitney_p(spark, d):
    df = table(spark, d, "documents").select((F.col("n_chars") % 500).alias("y"), (F.col("doc_id") % 2 == 0).alias("a"))
    sums = A.rank_sums(df, F.col("y"), F.col("a"))
    test = R._cells(lambda r, n1, n2, ties: P.mann_whitney(r, int(n1), int(n2), ties), "u double, p_two_sided double, p_greater double", *map(F.col, ("rank_sum", "n1", "n2", "ties")))
    return sums.withColumn("x", test).select("n1", "n2", scaled("x.u", "u2", 2), scaled("x.p_two_sided", "p_two", 1000), scaled("x.p_greater", "p_greater", 1000))


@query("concentration", Q.sql(Q.SIG.replace("min((task_id, idx))", "min((cast(task_id as varchar), idx))"), """select 'tb' as source, count(*) as n_signatures, cast(round(avg(t) * 1000) as bigint) as mean_top3, cast(round(median(t) * 1000) as bigint) as median_top3 from (
    select *, bool_or(about) over () as any_about from (select key, sum(p) filter (where rank <= 3) as t, coalesce(bool_or(contains(entity, 'test') or contains(entity, 'command')) filter (where rank = 1), false) as about
      from shr where level = 0 group by key)) where about or not any_about"""))  # fmt: skip
def concentration(spark, d):
    return A.concentration(_dist(spark, d).filter("level = 0")).select("source", "n_signatures", scaled("mean_top3", "mean_top3", 1000), scaled("median_top3", "median_top3", 1000))


@query("entropy_stats", Q.sql(Q.SIG, """select 'tb' as source, count(*) as keys, cast(round(avg(h) * 1000) as bigint) as mean, cast(round(median(h) * 1000) as bigint) as median, cast(round(stddev_pop(h) * 1000) as bigint) as std,
    cast(round(min(h) * 1000) as bigint) as min, cast(round(max(h) * 1000) as bigint) as max from (select key, -sum(p * ln(p)) as h from shr where level = 0 group by key)"""))  # fmt: skip
def entropy_stats(spark, d):
    out = A.entropy_summary(_dist(spark, d).filter("level = 0"))
    return out.select("source", "keys", *[scaled(c, c, 1000) for c in ("mean", "median", "std", "min", "max")])


@query("results_status", "select 'full' as place, 'complete' as status, cast(count(distinct lang) as bigint) as files from documents union all select 'none', 'raw_results_not_available', 0")
def results_status(spark, d):
    """Whether there are results to analyse."""
    full = fresh(spark, "status")
    table(spark, d, "documents").select("lang", "doc_id").repartition("lang").write.partitionBy("lang").json(full)
    both = [X.results_status(spark, p).withColumn("place", F.lit(n)) for n, p in (("full", full), ("none", fresh(spark, "absent")))]
    return both[0].unionByName(both[1]).select("place", "status", "files")
