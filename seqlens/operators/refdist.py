"""State signatures and the empirical distribution of the next entity, with backoff over four levels.

Rows are constraints (chain_id, source, idx, <fields>), idx from 0. One running window a chain replaces re-reading prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order():
    return Window.partitionBy("chain_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)

LEVELS = (0, 1, 2, 3)


def entity(empty_is_miss: bool = False) -> Column:
    """The entity a constraint is about, in lower case. A missing phase or resource is null, or empty with empty_is_miss."""
    kept = lambda c: F.coalesce(F.lower(c), F.lit("")) if empty_is_miss else F.nullif(F.lower(c), F.lit(""))
    named = lambda c: F.nullif(F.lower(c), F.lit(""))
    return (
        F.when(F.col("type") == "ToolAvailability", named("tool"))
        .when(F.col("type") == "InformationState", F.lower(F.try_element_at("observable_added", F.lit(1))))
        .when(F.col("type") == "SubGoalTransition", kept("to_phase"))
        .when(F.col("type") == "ResourceBudget", kept("resource"))
        .when(F.col("type") == "CoordinationDependency", named("dependency"))
        .when(F.col("type") == "OptimizationCriterion", named("objective"))
    )


def bracket(amount: Column) -> Column:
    return F.when(amount <= 0, 0).when(amount < 0.25, 1).when(amount < 0.5, 2).when(amount < 0.75, 3).otherwise(4)


def signatures(rows: DataFrame, exclusive: bool = False) -> DataFrame:
    """Adds the state at each step: phase_now, command_now, context_bracket, patience_bracket, status, field, turn.

    The prefix holds the step itself; with exclusive it ends before it."""
    w = order() if not exclusive else Window.partitionBy("chain_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, True).over(w)
    kind = lambda k: F.col("type") == k
    amount = lambda r: F.coalesce(last(F.when(kind("ResourceBudget") & (F.col("resource") == r) & (F.col("amount") != 1.0), F.col("amount"))), F.lit(1.0))
    seen = F.array_distinct(F.flatten(F.collect_list(F.when(kind("InformationState"), F.col("observable_added"))).over(w)))
    deps = F.collect_set(F.when(kind("CoordinationDependency") & (F.col("dependency") != ""), F.concat_ws("_", "dependency", F.coalesce("role", F.lit(""))))).over(w)
    # the last objective of each family (what stands before the first underscore)
    goals = F.collect_list(F.when(kind("OptimizationCriterion") & (F.col("objective") != ""), F.col("objective"))).over(w)
    newest = F.aggregate(
        goals,
        F.array().cast("array<string>"),
        lambda acc, g: F.concat(F.filter(acc, lambda x: F.split_part(x, F.lit("_"), F.lit(1)) != F.split_part(g, F.lit("_"), F.lit(1))), F.array(g)),
    )
    return rows.select(
        "*",
        F.coalesce(last(F.when(kind("SubGoalTransition") & (F.col("to_phase") != "initial"), F.col("to_phase"))), F.lit("initial")).alias("phase_now"),
        F.coalesce(last(F.when(kind("ToolAvailability") & F.col("tool").startswith("command_"), F.col("tool"))), F.lit("command_unknown")).alias("command_now"),
        bracket(amount("context_window")).alias("context_bracket"),
        bracket(amount("patience_budget")).alias("patience_bracket"),
        F.array_sort(F.transform(seen, lambda e: F.concat(e, F.lit("_revealed")))).alias("status"),
        F.array_sort(F.array_union(deps, newest)).alias("field"),
        F.floor(F.col("timestamp") / 10).alias("turn"),
    )


def with_levels(signed: DataFrame) -> DataFrame:
    """A row for each backoff level, its key as text: level 1 drops field, 2 turn too, 3 status too."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), level_key(n).alias("key")) for n in LEVELS]))
    return signed.withColumn("__level", each).select("*", "__level.*").drop("__level")


def level_key(level: int) -> Column:
    joined = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    parts = [F.col("phase_now"), F.col("command_now"), F.col("context_bracket").cast("string"), F.col("patience_bracket").cast("string")]
    if level < 3:
        parts.append(joined("status"))
    if level < 1:
        parts.append(joined("field"))
    if level < 2:
        parts.append(F.col("turn").cast("string"))
    return F.concat_ws("|", *parts)


def build(rows: DataFrame) -> DataFrame:
    """(source, level, key, entity, cnt, first_seen): counts over all steps of all chains."""
    df = with_levels(signatures(rows)).withColumn("entity", entity()).filter("entity is not null")
    return df.groupBy("source", "level", "key", "entity").agg(F.count("*").alias("cnt"), F.min(F.struct("chain_id", "idx")).alias("first_seen"))


def add_observations(dist: DataFrame, more: DataFrame) -> DataFrame:
    both = dist.unionByName(more)
    return both.groupBy("source", "level", "key", "entity").agg(F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen"))


def with_shares(dist: DataFrame) -> DataFrame:
    """p and rank within a key; ties by first appearance."""
    key = Window.partitionBy("source", "level", "key")
    df = dist.withColumn("p", F.col("cnt") / F.sum("cnt").over(key))
    return df.withColumn("rank", F.row_number().over(key.orderBy(F.desc("cnt"), "first_seen")))


def top_k(dist: DataFrame, k: int = 3) -> DataFrame:
    return with_shares(dist).filter(F.col("rank") <= k)


def stats(dist: DataFrame) -> DataFrame:
    return dist.groupBy("source", "level").agg(F.countDistinct("key").alias("keys"), F.sum("cnt").alias("observations"))


def lookup(queries: DataFrame, dist: DataFrame) -> DataFrame:
    """queries: rows with (query_id, source) and signature columns. (query_id, level, entities): the distribution at the first
    level that has the key, best first, each with its share and count; queries without one get level 3 and none."""
    best = first_levels(queries, dist)
    shares = with_shares(dist).groupBy("source", "level", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "entity", "p", "cnt"))).alias("entities"))
    s = shares.select(F.col("source").alias("__source"), F.col("level").alias("__level"), F.col("key").alias("__key"), "entities")
    # by source and key alone, as the distribution is dealt; the level is compared beside
    same = (F.col("source") == F.col("__source")) & (F.col("key") == F.col("__key")) & (F.col("level") - F.col("__level") == 0)
    return best.join(s.hint("merge"), same, "left").select("query_id", F.coalesce("level", F.lit(3)).alias("level"), "entities")


def first_levels(queries: DataFrame, dist: DataFrame) -> DataFrame:
    """(query_id, source, level, key): the first level of each query that the distribution knows, null if none. Only keys meet
    here; a query's four keys lie in one row, so no row is shuffled by its query."""
    known = dist.select("source", "level", "key").distinct()
    df = queries.select("query_id", "source", *[level_key(n).alias(f"__k{n}") for n in LEVELS])
    for n in LEVELS:
        own = known.filter(F.col("level") == n).select("source", F.col("key").alias(f"__k{n}"), F.lit(n).alias(f"__l{n}"))
        # keys of level 3 are few; the others grow with the data, and files tell little of how many a broadcast would hold
        df = df.join(own if n == LEVELS[-1] else own.hint("merge"), ["source", f"__k{n}"], "left")
    level = F.coalesce(*[F.col(f"__l{n}") for n in LEVELS])
    key = F.coalesce(*[F.when(F.col(f"__l{n}").isNotNull(), F.col(f"__k{n}")) for n in LEVELS])
    return df.select("query_id", "source", level.alias("level"), key.alias("key"))


def coverage(rows: DataFrame, dist: DataFrame) -> DataFrame:
    """Share of all steps whose lookup needs no maximum backoff, by source."""
    steps = signatures(rows).withColumn("query_id", F.struct("chain_id", "idx"))
    found = first_levels(steps, dist)
    return found.groupBy("source").agg(F.count("*").alias("steps"), F.count_if(F.col("level") < 3).alias("covered"))
