"""Evaluation matrix, scoring of responses, pairing of real and shuffled chains, and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import running_total
from ..functions.text import normalize_action
from .chains import PROMPT_VERSION, SYSTEM_PROMPT
from .refdist import entity, lookup, signatures

# Evaluation settings, chunk, and the types that call for an action.
CONFIGS = [(0.0, 42), (0.7, 42), (0.7, 1337)]
CHUNK = 10_000
ACTIONABLE = ("ToolAvailability", "InformationState", "SubGoalTransition")
MARK = "_shuffled_"


def _each(df: DataFrame, settings: list[tuple], *names: str) -> DataFrame:
    """Every row with each of a few settings."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x, strict=True)]) for x in settings]
    return df.withColumn("__x", F.explode(F.array(*structs))).select("*", "__x.*").drop("__x")


def evaluation_matrix(chains: DataFrame, models: list[str], configs: list[tuple[float, int]] = CONFIGS, chunk: int = CHUNK) -> DataFrame:
    """chains (chain_id, ...) x models x configs with a sequential id and its chunk."""
    settings = [(m, i, t, s, j) for i, m in enumerate(models) for j, (t, s) in enumerate(configs)]
    ranked = running_total(chains, "chain_id", F.lit(1), "n")
    df = _each(ranked, settings, "model", "m", "temperature", "seed", "c")
    number = F.col("n") * len(settings) + F.col("m") * len(configs) + F.col("c")
    df = df.withColumn("custom_id", F.format_string("req%07d", number)).withColumn("chunk", F.floor(number / chunk))
    return df.drop("n", "m", "c")


def requests(chains: DataFrame, models: list[str], configs: list[tuple[float, int]] = CONFIGS) -> DataFrame:
    """The evaluation matrix of chains with their prompts: what a dry run shows and a client sends. Seeds are not sent."""
    made = evaluation_matrix(chains, models, configs)
    return made.select("custom_id", "chunk", "chain_id", "source", "cutoff_k", "model", "temperature", "seed", F.lit(SYSTEM_PROMPT).alias("system"), "prompt", F.lit(PROMPT_VERSION).alias("prompt_version"))


def route(made: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with their responses by custom_id; null where none came or it failed."""
    return made.join(results.select("custom_id", "response"), "custom_id", "left")


def base_id() -> Column:
    return F.substring_index("chain_id", MARK, 1)


def shuffle_seed() -> Column:
    return F.when(F.col("chain_id").contains(MARK), F.substring_index("chain_id", MARK, -1).try_cast("int"))


def scored(responses: DataFrame, rows: DataFrame, dist: DataFrame | None = None) -> DataFrame:
    """responses (query_id, chain_id, model, seed, temperature, cutoff_k, response) with layer 1 and 2.

    rows: constraints of all chains (chain_id, source, idx, <fields>). Adds source, gt_type, l1 (null where undefined),
    actionable, legality, optimality and coupled (rounded to 4 places)."""
    said = normalize_action(F.col("response"))
    state = ["phase_now", "command_now", "context_bracket", "patience_bracket", "status", "field", "turn"] if dist is not None else []
    steps = signatures(rows) if dist is not None else rows
    truth = steps.select(
        F.col("chain_id").alias("__chain"), F.col("idx").alias("__idx"), F.col("source").alias("chain_source"), F.col("type").alias("gt_type"),
        entity(empty_is_miss=True).alias("entity"), *[F.col(c).alias(f"__{c}") for c in state],
    )
    # by chain alone, as chains are dealt, the place compared beside; merged, as files tell little of how many rows a broadcast would hold
    same = (F.col("chain_id") == F.col("__chain")) & (F.col("cutoff_k") - F.col("__idx") == 0)
    df = responses.withColumn("said", said).join(truth.hint("merge"), same, "left").drop("__chain", "__idx")
    norm = normalize_action(F.col("entity"))
    df = df.withColumn("l1", F.when(F.col("entity").isNotNull(), ((norm != "") & F.col("said").contains(norm)).cast("int")))
    df = df.withColumn("actionable", F.coalesce(F.col("gt_type").isin(*ACTIONABLE), F.lit(False)))
    # latest state of each tool before the cut
    asked = responses.select("chain_id", "cutoff_k").distinct()
    tools = rows.filter((F.col("type") == "ToolAvailability") & F.col("state").isin("available", "unavailable")).select(
        "chain_id", "idx", F.lower("tool").alias("tool"), "state"
    )
    latest = asked.join(tools.hint("merge"), "chain_id").filter("idx < cutoff_k").groupBy("chain_id", "cutoff_k", "tool").agg(F.max_by("state", "idx").alias("state"))
    gone = latest.filter("state = 'unavailable' and tool <> ''").groupBy("chain_id", "cutoff_k").agg(F.sort_array(F.collect_set("tool")).alias("gone"))
    gone = gone.withColumnsRenamed({"chain_id": "__chain", "cutoff_k": "__idx"}).hint("merge")
    df = df.join(gone, same, "left").drop("__chain", "__idx").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    df = df.withColumn("legality", F.when(F.exists("gone", lambda u: F.col("said").contains(normalize_action(u))), 0.0).otherwise(1.0))
    if dist is not None:
        queries = df.filter("chain_source is not null").select("query_id", F.col("chain_source").alias("source"), *[F.col(f"__{c}").alias(c) for c in state])
        df = df.join(lookup(queries, dist).withColumnRenamed("level", "backoff").hint("merge"), "query_id", "left")
        free = F.filter(
            F.coalesce("entities", F.expr("cast(array() as array<struct<rank:int,entity:string,p:double,cnt:bigint>>)")),
            lambda e: (e["entity"] != "") & ~F.exists("gone", lambda u: F.lower(e["entity"]).contains(u)),
        )
        # counts, as sums of shares depend on their order
        mass = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, e: s + e["cnt"])
        places = lambda c: F.round(c * 10_000) / 10_000
        caught = F.filter(free, lambda e: F.col("said").contains(normalize_action(e["entity"])))
        share = F.when(mass(free) > 0, mass(caught) / mass(free)).otherwise(0.0)
        df = df.withColumn("__share", share).withColumn("optimality", places(F.col("__share")))
        df = df.withColumn("coupled", places(F.col("legality") * F.col("__share"))).drop("__share", "entities", *[f"__{c}" for c in state])
    return df.drop("said", "gone").withColumn("source", F.coalesce("source", "chain_source", F.lit("unknown")) if "source" in df.columns else F.coalesce("chain_source", F.lit("unknown"))).drop("chain_source")


def classify_chains(rows: DataFrame) -> DataFrame:
    """(chain_id, length_bucket, composition, archetype)."""
    kind = lambda k: F.col("type") == k
    df = rows.groupBy("chain_id").agg(
        F.count("*").alias("n"),
        F.count_if(kind("ResourceBudget")).alias("r"),
        F.count_if(kind("SubGoalTransition")).alias("s"),
        F.count_if(kind("ToolAvailability") & (F.col("state") == "unavailable") & F.col("recover_in").isNull()).alias("gone"),
        F.count_if(kind("ResourceBudget") & F.col("resource").contains("boost")).alias("boost"),
    )
    return df.select(
        "chain_id",
        F.when(F.col("n") <= 25, "short_20_25").when(F.col("n") <= 32, "medium_26_32").otherwise("long_33_40").alias("length_bucket"),
        F.when(F.col("r") > F.col("s"), "resource_dominated").when(F.col("s") > F.col("r"), "subgoal_dominated").otherwise("balanced").alias("composition"),
        F.when(F.col("gone") >= 4, "aggressive").when(F.col("boost") >= 3, "setup").otherwise("stall").alias("archetype"),
    )


def outcome_tier(gap: Column, p: Column) -> Column:
    return (
        F.when(gap < -0.01, "reversed")
        .when((F.abs(gap) < 0.02) & (p > 0.1), "null")
        .when((gap >= 0.08) & (p < 0.01), "strong_positive")
        .when((gap >= 0.05) & (p < 0.05), "moderate_positive")
        .otherwise("weak_mixed")
    )


def split_sides(scored_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(real, shuffled), the last row of each (chain, model, seed) by query_id."""
    newest = Window.partitionBy("chain_id", "model", "seed").orderBy(F.desc("query_id"))
    df = scored_rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")
    df = df.withColumn("base_id", base_id()).withColumn("shuffle_seed", shuffle_seed())
    return df.filter("shuffle_seed is null"), df.filter("shuffle_seed is not null")


def pairs(scored_rows: DataFrame) -> DataFrame:
    """Real and shuffled results aligned on (base chain, model, seed), every shuffle a pair; side: both, real_only, shuffled_only
    (a result that one shuffle lacks is real_only for that shuffle; a chain without shuffles is real_only once, without seed).
    Shuffles of bases without a real chain are left out."""
    cols = ["l1", "actionable", "gt_type", "optimality", "coupled", "source", "temperature"]
    cols = [c for c in cols if c in scored_rows.columns]
    df = scored_rows.select("chain_id", "model", "seed", "query_id", base_id().alias("base_id"), shuffle_seed().alias("shuffle_seed"), *cols)
    # all that follows is by base: one exchange
    df = df.repartition(int(scored_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "base_id")
    newest = Window.partitionBy("base_id", "chain_id", "model", "seed").orderBy(F.desc("query_id"))
    df = df.withColumn("__n", F.row_number().over(newest)).filter("__n = 1")
    base = Window.partitionBy("base_id")
    variant = F.when(F.col("shuffle_seed").isNotNull(), F.struct("chain_id", "shuffle_seed"))
    df = df.withColumns({"__all": F.collect_set(variant).over(base), "__real": F.bool_or(variant.isNull()).over(base)}).filter("__real")
    # a real result goes to every shuffle of its base (to none once, if there is none), a shuffled one to its own
    none = F.array(F.lit(None).cast("struct<chain_id:string,shuffle_seed:int>"))
    goes = F.when(variant.isNotNull(), F.array(variant)).when(F.size("__all") > 0, F.col("__all")).otherwise(none)
    values = F.struct(*cols)
    df = df.select("base_id", "model", "seed", F.explode(goes).alias("v"), F.when(variant.isNull(), values).alias("a"), F.when(variant.isNotNull(), values).alias("b"))
    df = df.select("base_id", "model", "seed", F.col("v.chain_id").alias("variant"), F.col("v.shuffle_seed").alias("shuffle_seed"), "a", "b")
    df = df.groupBy("base_id", "model", "seed", "variant").agg(F.max("shuffle_seed").alias("shuffle_seed"), F.first("a", True).alias("a"), F.first("b", True).alias("b"))
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "real_only").otherwise("shuffled_only")
    sides = [F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("a", "real"), ("b", "shuffled")) for c in cols]
    return df.select("base_id", "model", "seed", "shuffle_seed", *sides, side.alias("side"))


def unpaired_bases(scored_rows: DataFrame) -> DataFrame:
    """Real chains that have no shuffle."""
    real, other = split_sides(scored_rows)
    return real.select("base_id").distinct().join(other.select("base_id").distinct(), "base_id", "left_anti")


def config() -> Column:
    return F.concat(F.lit("T"), F.col("temperature").cast("string"), F.lit("_seed"), F.col("seed").cast("string"))


def condition() -> Column:
    return F.when(F.col("chain_id").contains(MARK), "shuffled").otherwise("real")


def grouping_families(scored_rows: DataFrame) -> DataFrame:
    """Counts by condition in four groupings at once: model; with source; with config; with both. -- stands for all."""
    df = scored_rows.withColumn("config", config()).withColumn("condition", condition())
    sets = [["model"], ["model", "source"], ["model", "config"], ["model", "source", "config"]]
    known = F.col("l1").isNotNull()
    out = df.groupingSets([[*s, "condition"] for s in sets], "model", "source", "config", "condition").agg(
        F.count("l1").alias("n"),
        F.coalesce(F.sum("l1"), F.lit(0)).alias("hits"),
        F.count_if(F.col("actionable") & known).alias("n_actionable"),
        F.coalesce(F.sum(F.when(F.col("actionable"), F.col("l1"))), F.lit(0)).alias("hits_actionable"),
    )
    return out.fillna("--", ["source", "config"])


def by_subset(scored_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Layer 1 counts by model, condition and each class of the chain (subset, value); an undefined result counts as a miss,
    results without a chain are left out."""
    names = ["length_bucket", "composition", "archetype"]
    df = scored_rows.withColumn("condition", condition()).join(classify_chains(rows), "chain_id")
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("subset"), F.col(c).alias("value")) for c in names]))
    df = df.select("model", "condition", F.coalesce("l1", F.lit(0)).alias("l1"), classes.alias("c")).select("*", "c.*")
    return df.groupBy("model", "subset", "value", "condition").agg(F.count("*").alias("n"), F.sum("l1").alias("hits"))


def legacy_id(model: Column, seed: Column, chain_id: Column) -> Column:
    return F.concat_ws("||", model, seed.cast("string"), chain_id)


def from_legacy_id(custom_id: Column) -> Column:
    """(model, seed, chain_id); the chain id may hold the separator."""
    part = F.split(custom_id, r"\|\|", 3)
    return F.struct(part[0].alias("model"), part[1].cast("int").alias("seed"), part[2].alias("chain_id"))


def by_type(scored_rows: DataFrame) -> DataFrame:
    df = scored_rows.withColumn("condition", condition()).filter("l1 is not null")
    return df.groupBy("model", "source", "gt_type", "condition").agg(F.count("l1").alias("n"), F.sum("l1").alias("hits"))


def paired_cells(aligned: DataFrame, actionable: str = "both") -> DataFrame:
    """Cells n11, b (real only), c (shuffled only), n00 by model and source; actionable: all, real (side) or both (sides)."""
    df = aligned.filter("side = 'both' and real_l1 is not null and shuffled_l1 is not null")
    if actionable != "all":
        df = df.filter("real_actionable" if actionable == "real" else "real_actionable and shuffled_actionable")
    cell = lambda r, s: F.count_if((F.col("real_l1") == r) & (F.col("shuffled_l1") == s))
    return df.groupBy("model", F.col("real_source").alias("source")).agg(
        cell(1, 1).alias("n11"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("n00"), F.count("*").alias("n_pairs")
    )


def bonferroni(cells: DataFrame, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """The p-value, already rounded to 4 places, times the number of cells, at most 1."""
    n = F.count("*").over(Window.partitionBy(*[F.col(c) for c in by or []]))  # cells are few: a window over all of them will do
    return cells.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * n))


def thresholds(cells: DataFrame) -> DataFrame:
    """Whether any cell of a model has a gap of 0.05 with p below 0.05."""
    return cells.groupBy("model").agg(F.bool_or((F.col("gap") >= 0.05) & (F.col("p_value") < 0.05)).alias("any_significant"))


def synthetic_responses(rows: DataFrame, models: list[str], configs: list[tuple[float, int]] = CONFIGS) -> DataFrame:
    """A stand-in for a model: it answers with the entity of an earlier step that a digest of its inputs picks."""
    n = Window.partitionBy("chain_id")
    df = rows.withColumn("n", F.count("*").over(n)).withColumn("entity", entity()).withColumn("cutoff_k", F.greatest(F.lit(1), F.expr("n div 2")).cast("int"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "chain_id", "model", F.col("seed").cast("string"))), 1, 6), 16, 10).cast("int"), F.col("n"))
    df = _each(df, [(m, t, s) for m in models for t, s in configs], "model", "temperature", "seed").filter(F.col("idx") == pick)
    said = F.concat(F.lit("use "), F.coalesce("entity", F.lit("nothing")))
    return df.select(
        F.concat_ws(":", "chain_id", "model", F.col("seed").cast("string"), F.col("temperature").cast("string")).alias("query_id"),
        "chain_id", "model", "seed", "temperature", "cutoff_k", said.alias("response"),
    )


def blinded(responses: DataFrame) -> DataFrame:
    """One row of each (chain, cutoff), the last by query_id, without model and settings."""
    newest = Window.partitionBy("chain_id", "cutoff_k").orderBy(F.desc("query_id"))
    return responses.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").select("chain_id", "cutoff_k", "response")
