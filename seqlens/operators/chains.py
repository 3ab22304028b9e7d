"""From constraints to chains: observability, validity, permutation, rendering and prompts."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import leaked_terms
from ..schemas import CONSTRAINT_FIELDS

# Lengths, counts, seeds and the prompt that goes with every request.
LEAST, MOST = 20, 40
LEAST_SUBGOALS, LEAST_UNAVAILABLE, LEAST_BUDGETS = 2, 1, 10
SEEDS = (42, 1337, 7919)
PROMPT_VERSION = "v2.0-code"
SYSTEM_PROMPT = """You are reasoning about an adaptive pipeline that operates under
a sequence of changing constraints. At each step, new constraints
may appear, existing constraints may change, and resources may
be depleted. Your job is to propose the correct adaptation at
each step, given the full prior history.

At each step you receive a partially-observable state: you see
the constraints and resource levels that have been revealed, but
some entities remain hidden until they are explicitly surfaced
through an action or information event.

Constraints carry forward unless explicitly superseded. Treat
"tool UNAVAILABLE" as persistent unless a later event makes it
available again."""
FILE_ENTITY = r"(file_[A-Z](?:_OVERFLOW_\d+)?)"

FIELDS = [n for n, _ in CONSTRAINT_FIELDS]

def order():
    return Window.partitionBy("task_id").orderBy("idx")



def first_reveals(rows: DataFrame) -> DataFrame:
    """(task_id, entity, reveal): the first index at which each entity can be observed."""
    seen = rows.filter(F.col("type") == "InformationState").select("task_id", "idx", F.explode("observable_added").alias("entity"))
    return seen.groupBy("task_id", "entity").agg(F.min("idx").alias("reveal"))


def observe(rows: DataFrame) -> DataFrame:
    """Drops availability of tools, and budgets of files, that are revealed only later; orig_idx keeps the place, idx is dense."""
    entity = F.when(F.col("type") == "ToolAvailability", F.col("tool")).when(
        (F.col("type") == "ResourceBudget"), F.nullif(F.regexp_extract(F.coalesce("resource", F.lit("")), FILE_ENTITY, 1), F.lit(""))
    )
    # each row probes for its entity, and sightings go along as copies: a window instead of a join that reads all rows twice
    seen = F.when(F.col("type") == "InformationState", F.col("observable_added"))
    copies = F.coalesce(F.transform(seen, lambda x: F.struct(x.alias("entity"), F.lit(True).alias("copy"))), F.expr("cast(array() as array<struct<entity:string,copy:boolean>>)"))
    both = F.concat(F.array(F.struct(entity.alias("entity"), F.lit(False).alias("copy"))), copies)
    df = rows.withColumn("__e", F.explode(both))
    reveal = F.min(F.when(F.col("__e.copy"), F.col("idx"))).over(Window.partitionBy("task_id", "__e.entity"))
    df = df.withColumn("__reveal", reveal).filter("not __e.copy and (__reveal is null or idx >= __reveal)")
    kept = df.drop("__e", "__reveal")
    return kept.withColumnRenamed("idx", "orig_idx").withColumn("idx", F.row_number().over(Window.partitionBy("task_id").orderBy("orig_idx")) - 1)


def truncate(rows: DataFrame, most: int = MOST) -> DataFrame:
    return rows.filter(F.col("idx") < most)


def resource_bucket(amount: Column) -> Column:
    return F.when(amount <= 0, 0.0).when(amount <= 0.25, 0.25).when(amount <= 0.5, 0.5).when(amount <= 0.75, 0.75).otherwise(1.0)


def _compared(rows: DataFrame) -> DataFrame:
    """Each row with whether it is late enough and the same as the one before it."""
    same = F.struct(*FIELDS).eqNullSafe(F.lag(F.struct(*FIELDS)).over(order()))
    return rows.withColumn("__late", F.coalesce(F.col("timestamp") >= F.lag("timestamp").over(order()), F.lit(True))).withColumn("__same", same)


def _counts() -> dict[str, Column]:
    """What is counted of a chain."""
    return {
        "n": F.count("*"),
        "subgoals": F.count_if(F.col("type") == "SubGoalTransition"),
        "unavailable": F.count_if((F.col("type") == "ToolAvailability") & (F.col("state") == "unavailable")),
        "budgets": F.count_if(F.col("type") == "ResourceBudget"),
        "ordered": F.bool_and("__late"),
        "distinct": F.bool_and(~F.col("__same")),
    }


def _is_valid() -> Column:
    return (
        F.col("n").between(LEAST, MOST)
        & (F.col("subgoals") >= LEAST_SUBGOALS)
        & (F.col("unavailable") >= LEAST_UNAVAILABLE)
        & (F.col("budgets") >= LEAST_BUDGETS)
        & F.col("ordered")
        & F.col("distinct")
    )


def validity(rows: DataFrame) -> DataFrame:
    """(task_id, n, subgoals, unavailable, budgets, ordered, distinct, valid) of each chain."""
    out = _compared(rows).groupBy("task_id").agg(*[c.alias(n) for n, c in _counts().items()])
    return out.withColumn("valid", _is_valid())


def valid_rows(rows: DataFrame) -> DataFrame:
    """The constraints of valid chains, by windows that share the rows' partitioning: nothing is read twice or joined."""
    whole = Window.partitionBy("task_id")
    df = _compared(rows)
    df = df.select("*", *[c.over(whole).alias(n) for n, c in _counts().items()])
    return df.filter(_is_valid()).select(*rows.columns)


def assemble(rows: DataFrame) -> DataFrame:
    """(task_id, constraints, active_pairs, valid): a row a chain."""
    item = F.struct("idx", F.struct(*FIELDS).alias("c"), F.array("phase", "cmd_label").alias("pair"))
    sets = _compared(rows).groupBy("task_id").agg(F.sort_array(F.collect_list(item)).alias("x"), *[c.alias(n) for n, c in _counts().items()])
    return sets.select("task_id", F.expr("transform(x, y -> y.c)").alias("constraints"), F.expr("transform(x, y -> y.pair)").alias("active_pairs"), _is_valid().alias("valid"))


def permutation(n: int, seed: int) -> list[int]:
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def permutation_table(spark: SparkSession, seeds: tuple[int, ...] = SEEDS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """A permutation depends on length and seed only: a few dozen rows for any input."""
    rows = [(n, s, permutation(n, s)) for n in range(least, most + 1) for s in seeds]
    return spark.createDataFrame(rows, "n int, shuffle_seed int, perm array<int>")


def _retimed(constraints: str, times: str) -> str:
    fields = ", ".join(f"'{n}', " + (f"{times}[i]" if n == "timestamp" else f"c.{n}") for n in FIELDS)
    return f"transform({constraints}, (c, i) -> named_struct({fields}))"


def permute(chains: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Each chain under each seed: constraints and pairs permuted alike, the i-th gets the i-th smallest timestamp; the id is
    rewritten and match_id kept. Other fields are those of the real chain."""
    table = F.broadcast(permutation_table(chains.sparkSession, seeds))
    df = chains.withColumn("n", F.size("constraints")).join(table, "n")
    df = df.withColumn("__times", F.expr("array_sort(transform(constraints, c -> c.timestamp))"))
    df = df.withColumn("constraints", F.expr("transform(perm, p -> constraints[p])"))
    df = df.withColumn("constraints", F.expr(_retimed("constraints", "__times")))
    df = df.withColumn("active_pairs", F.expr("transform(perm, p -> active_pairs[p])"))
    df = df.withColumn("chain_id", F.concat("chain_id", F.lit("_shuffled_"), F.col("shuffle_seed").cast("string")))
    return df.drop("perm", "__times", "n")


RENDER = """case
  when c.type = 'ResourceBudget' then concat('ResourceBudget: ', c.resource, ' at ', format_string('%.1f', c.amount * 100), '%',
    if(c.decay <> 'none', concat(' (decay=', c.decay, ')'), ''), if(c.recover_in is not null, concat(' (recover_in=', c.recover_in, ' steps)'), ''))
  when c.type = 'ToolAvailability' then concat('ToolAvailability: ', c.tool, ' is now ', upper(c.state),
    case when c.state = 'unavailable' and c.recover_in is null then ' (permanent)'
         when c.state = 'unavailable' then concat(' (recover_in=', c.recover_in, ')') else '' end)
  when c.type = 'SubGoalTransition' then concat("SubGoalTransition: phase shifted from '", c.from_phase, "' to '", c.to_phase, "' (trigger=", c.trigger, ')')
  when c.type = 'InformationState' then concat('InformationState: added=[', coalesce(nullif(array_join(c.observable_added, ', '), ''), '(empty)'),
    '] removed=[', coalesce(nullif(array_join(c.observable_removed, ', '), ''), '(empty)'), '] uncertainty=', format_string('%.2f', c.uncertainty))
  when c.type = 'CoordinationDependency' then concat('CoordinationDependency: ', c.role, ' depends on ', c.dependency, ' -> expected_action=', c.expected_action)
  when c.type = 'OptimizationCriterion' then concat('OptimizationCriterion: objective=', c.objective, ' weight_shift=', c.weight_shift)
  else concat('UnknownConstraint: ', to_json(c)) end"""


def step_lines(constraints: str = "constraints") -> Column:
    """Two lines a constraint."""
    return F.expr(f"transform({constraints}, (c, i) -> concat('Step ', i + 1, ' (step=', coalesce(c.timestamp, 0), '):\\n  ', {RENDER}))")


def render(chains: DataFrame, perspective: str = "agent", vocabulary: list[str] | None = None) -> DataFrame:
    """rendered, and leaked: the terms that keep a chain out."""
    head = f"# Constraint chain (perspective={perspective})\n"
    body = F.when(F.size("constraints") == 0, F.lit("(no constraints)\n")).otherwise(F.concat(F.array_join(step_lines(), "\n"), F.lit("\n")))
    df = chains.withColumn("rendered", F.concat(F.lit(head), body))
    return df.withColumn("leaked", leaked_terms(F.col("rendered"), vocabulary))


def render_source(chains: DataFrame, source: str = "tb", vocabulary: list[str] | None = None) -> DataFrame:
    """A chain of a source is seen from that source's perspective."""
    return render(chains, source, vocabulary)


def shuffled(chains: DataFrame, source: str, vocabulary: list[str] | None = None, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """The permutations of real chains, each rendered anew; one that leaks is left out, its chain and the others stay."""
    return render_source(permute(chains, seeds), source, vocabulary).filter(F.size("leaked") == 0).drop("leaked")


def first_steps(k: Column) -> Column:
    """The text of the first k steps of `constraints`; empty where k is not positive."""
    return F.when(k <= 0, F.lit("")).otherwise(F.array_join(F.slice(step_lines(), 1, F.greatest(k, F.lit(0))), "\n"))


def prompts(chains: DataFrame) -> DataFrame:
    """cutoff_k and the user's prompt: the first k steps and the question for the next."""
    k = F.greatest(F.lit(1), F.expr("size(constraints) div 2")).cast("int")
    shown = first_steps(F.col("cutoff_k"))
    question = F.concat(
        F.lit("\n\n---\n\nGiven the state above, propose the next action for your pipeline at\nstep "),
        (F.col("cutoff_k") + 1).cast("string"),
        F.lit('. Output only the action label (e.g., "use command_2" or "switch to file_C"). No explanation.'),
    )
    df = chains.withColumn("cutoff_k", k)
    return df.withColumn("prompt", F.concat(F.rtrim(shown), question))


def build_chains(rows: DataFrame, source: str, vocabulary: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chains, reasons): admitted real chains, and (task_id, reason) of every trajectory: accepted, filter_fail or leakage."""
    named = F.concat(F.lit(f"{source}_"), F.col("task_id").cast("string"))
    full = assemble(truncate(observe(rows))).withColumn("chain_id", named).withColumn("match_id", named).withColumn("source", F.lit(source))
    chains = prompts(render_source(full.filter("valid"), source, vocabulary).filter(F.size("leaked") == 0)).drop("leaked", "valid")
    drawn = render_source(full, source, vocabulary)
    reason = F.when(~F.col("valid"), "filter_fail").when(F.size("leaked") > 0, "leakage").otherwise("accepted")
    return chains, drawn.select("task_id", reason.alias("reason"))
