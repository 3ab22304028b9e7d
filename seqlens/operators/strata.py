"""Statistics by strata: sufficient statistics in Spark, formulas as Columns; p-values of the few cells by functions.stats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as P
from ..functions.ordering import medians, running_total
from .refdist import with_shares


def two_sample_z(df: DataFrame, by: str, hit: Column, first: Column) -> DataFrame:
    """n1, n2, p1, p2, gap, z of hits in the rows where `first` holds against the others, by a column."""
    one = lambda c: F.count_if(c)
    g = df.groupBy(by).agg(one(first).alias("n1"), one(~first).alias("n2"), one(first & hit).alias("h1"), one(~first & hit).alias("h2")).filter("n1 > 0 and n2 > 0")
    g = g.withColumn("p1", F.col("h1") / F.col("n1")).withColumn("p2", F.col("h2") / F.col("n2"))
    p = (F.col("h1") + F.col("h2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n2")))
    return g.withColumn("gap", F.col("p1") - F.col("p2")).withColumn("z", F.when(se > 0, F.col("gap") / se).otherwise(0.0))


def welch_t(df: DataFrame, by: str, value: Column, first: Column) -> DataFrame:
    of = lambda f, c: f(F.when(c, value))
    g = df.groupBy(by).agg(
        of(F.avg, first).alias("m1"), of(F.avg, ~first).alias("m2"), of(F.var_samp, first).alias("v1"), of(F.var_samp, ~first).alias("v2"),
        of(F.count, first).alias("n1"), of(F.count, ~first).alias("n2"),
    ).filter("n1 > 1 and n2 > 1")
    return g.withColumn("t", (F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")))


def paired_t_stat(df: DataFrame, by: str, difference: Column) -> DataFrame:
    g = df.groupBy(by).agg(F.avg(difference).alias("mean"), F.stddev_samp(difference).alias("sd"), F.count(difference).alias("n")).filter("n > 1")
    return g.withColumn("t", F.col("mean") / (F.col("sd") / F.sqrt("n")))


def rank_sums(df: DataFrame, value: Column, first: Column) -> DataFrame:
    """n1, n2, rank_sum of the first sample (average ranks) and ties (sum of t**3 - t), without ranking rows in one task:
    values are counted first, and the ranks of distinct values follow from running counts over range partitions."""
    counts = df.groupBy(value.alias("v")).agg(F.count("*").alias("t"), F.count_if(first).alias("a"))
    ranked = running_total(counts, "v", F.col("t"), "below")
    rank = F.col("below") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    return ranked.agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(rank * F.col("a")).alias("rank_sum"), F.sum(t * t * t - t).alias("ties"))


def cutoff_bins(fraction: Column) -> Column:
    """Half-open bins of a tenth from 0.3 to 0.7."""
    bins = [(0.3, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 0.7)]
    out = F.when(F.lit(False), "")
    for lo, hi in bins:
        out = out.when((fraction >= lo) & (fraction < hi), f"{lo}-{hi}")
    return out


def sample_by_digest(df: DataFrame, strata: list[str], key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each stratum, picked by a digest of key and seed: the same on every run."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def key_entropy(dist: DataFrame) -> DataFrame:
    """Entropy in nats, share of the three best, and the best entity of each key."""
    df = with_shares(dist)
    return df.groupBy("source", "level", "key").agg(
        (-F.sum(F.col("p") * F.log("p"))).alias("entropy"),
        F.sum(F.when(F.col("rank") <= 3, F.col("p")).otherwise(0.0)).alias("top3"),
        F.max(F.when(F.col("rank") == 1, F.col("entity"))).alias("best"),
    )


def entropy_summary(dist: DataFrame) -> DataFrame:
    e, keys = F.col("entropy"), key_entropy(dist)
    whole = keys.groupBy("source").agg(F.count("*").alias("keys"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"))
    return whole.join(medians(keys, "source", e, "median"), "source").select("source", "keys", "mean", "median", "std", "min", "max")


def concentration(dist: DataFrame) -> DataFrame:
    """Number of keys whose best entity is about tests or commands (all keys of a source where there are none), mean and median
    of what their three best entities cover."""
    df = key_entropy(dist)
    about = F.col("best").contains("test") | F.col("best").contains("command")
    df = df.withColumn("about", about).withColumn("any", F.bool_or("about").over(Window.partitionBy("source"))).filter("about or not any")
    whole = df.groupBy("source").agg(F.count("*").alias("n_signatures"), F.avg("top3").alias("mean_top3"))
    return whole.join(medians(df, "source", F.col("top3"), "median_top3"), "source")


def gap_interval(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Unpooled interval of gap from p1, n1, p2, n2."""
    se = F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n1") + F.col("p2") * (1 - F.col("p2")) / F.col("n2"))
    return df.withColumn("gap_low", F.col("gap") - z * se).withColumn("gap_high", F.col("gap") + z * se)


#: The types among which a carrier is looked for, and the one that is tested against the others.
CARRIERS = ("ResourceBudget", "ToolAvailability", "InformationState", "SubGoalTransition", "CoordinationDependency")
TESTED = "InformationState"


def carrier_table(cells: DataFrame, least: int = 10) -> DataFrame:
    """cells (model, source, gt_type, n_real, real_rate, gap): hits of the tested type (rate times n) and of the others (gap times
    n of those with a gap above 0 and enough real rows), by model and source."""
    of = cells.filter(F.col("gt_type").isin(*CARRIERS))
    tested, n = F.col("gt_type") == TESTED, F.col("n_real")
    other = ~tested & (n >= least) & (F.col("gap") > 0)
    return of.groupBy("model", "source").agg(
        F.coalesce(F.sum(F.when(tested, F.rint(F.round("real_rate", 4) * n))), F.lit(0)).cast("bigint").alias("tested_hits"),
        F.coalesce(F.sum(F.when(other, F.rint(F.round("gap", 4) * n))), F.lit(0)).cast("bigint").alias("other_hits"),
    )


def carrier(cells: DataFrame, least: int = 10) -> DataFrame:
    """The type with the largest gap of each model and source among those with enough real rows."""
    return cells.filter(F.col("n_real") >= least).groupBy("model", "source").agg(F.max_by("gt_type", "gap").alias("carrier"), F.max("gap").alias("gap"))


def inverse_variance_pool(cells: DataFrame, by: str) -> DataFrame:
    w = 1 / (F.col("se") * F.col("se"))
    g = cells.groupBy(by).agg((F.sum(w * F.col("gap")) / F.sum(w)).alias("gap"), F.sqrt(1 / F.sum(w)).alias("se"))
    return g.withColumn("z", F.col("gap") / F.col("se"))


def with_p_values(cells: DataFrame, fn: Callable[..., float], inputs: list[str], name: str = "p_value") -> DataFrame:
    """fn of a few columns for each cell, one by one in Python: for cells of a report, not for rows of data."""

    @F.pandas_udf("double")
    def of(*cols):
        import pandas as pd

        return pd.Series([fn(*row) for row in zip(*cols, strict=True)])

    return cells.withColumn(name, of(*[F.col(c) for c in inputs]))


def z_p_values(cells: DataFrame) -> DataFrame:
    return with_p_values(cells, P.two_sided, ["z"])
