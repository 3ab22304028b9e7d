"""Translation of events into typed constraints.

What is carried from event to event is folded (`fold.py`): a trajectory is cut into parts of PART steps, and where there are several,
each part is summarised apart, the summaries compose to the state each part starts with, and the parts are folded apart: a long
trajectory is the work of many tasks, and none holds more than a part. Constraints are then made of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..schemas import CONSTRAINT_FIELDS
from . import fold
from .fold import PHASES, POOL

#: Steps of a part.
PART = 1 << 16


def _complete(events: DataFrame) -> DataFrame:
    """Columns that an input may lack become null."""
    want = {
        "command": "string", "path": "string", "error_type": "string", "outcome": "string", "from_phase": "string", "to_phase": "string",
        "reason": "string", "trigger": "string", "tokens_used": "bigint", "tokens_max": "bigint",
    }
    return events.select("*", *[F.lit(None).cast(t).alias(n) for n, t in want.items() if n not in events.columns])


def readable(events: DataFrame, *others: str) -> DataFrame:
    """What the fold and the constraints read of events, with the part each lies in (and other columns as they are)."""
    df = _complete(events)
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    stem = F.coalesce(F.try_element_at(tokens(F.coalesce("command", F.lit(""))), F.lit(1)), F.lit("unknown"))
    name = (
        F.when(F.col("type").isin(*fold.FILES), nonempty("path"))
        .when(F.col("type") == "error_reveal", F.coalesce(nonempty("error_type"), F.lit("RuntimeError")))
        .when(F.col("type") == "bash_call", stem)
    )
    return df.select(
        "task_id", F.floor(F.col("step") / PART).alias("part"), "step", "type", F.when(F.col("outcome") == "pass", "pass").otherwise("fail").alias("outcome"),
        "from_phase", "to_phase", F.coalesce(nonempty("reason"), nonempty("trigger"), F.lit("task_transition")).alias("trigger"), name.alias("name"),
        F.col("tokens_used").cast("long").alias("tokens_used"), F.col("tokens_max").cast("long").alias("tokens_max"), *others,
    )


def _labels() -> tuple[Column, Column]:
    """Names of files and errors, and of the last command, by first use."""
    letter = lambda r: F.char(r + 65)
    n = F.col("number")
    file = F.when(n < POOL, F.concat(F.lit("file_"), letter(n))).otherwise(F.concat(F.lit("file_OVERFLOW_"), (n - POOL + 1).cast("string")))
    label = F.when(F.col("type").isin(*fold.FILES), file).when(F.col("type") == "error_reveal", F.concat(F.lit("error_class_"), letter(n)))
    return label, F.concat(F.lit("command_"), (F.col("cmd") + 1).cast("string"))


def _patience() -> Column:
    """What repeated subtraction of 0.15 from 1 leaves, rounded: exact for every number of failures."""
    steps = [1.0]
    while steps[-1] > 0:
        steps.append(max(0.0, steps[-1] - 0.15))
    table = F.array(*[F.lit(round(x, 3)) for x in steps])
    return F.element_at(table, F.least(F.col("fails"), F.lit(len(steps) - 1)).cast("int") + 1)


def part_starts(df: DataFrame) -> DataFrame:
    """The state with which each part but the first of a long trajectory starts. df as readable() gives it."""
    several = df.filter(F.col("step") >= PART).select("task_id").distinct()
    cut = df.join(several, "task_id", "left_semi")
    id_type = df.schema["task_id"].dataType.simpleString()
    summaries = cut.groupBy("task_id", "part").applyInArrow(fold.summarise, f"task_id {id_type}, part long, first_step long, {fold.SUMMARY_FIELDS}")
    return summaries.groupBy("task_id").applyInArrow(fold.starts, f"task_id {id_type}, part long, first_step long, {fold.START_FIELDS}")


def folded(events: DataFrame) -> DataFrame:
    """Events with seq and place (of their first constraint), label (of files and errors), cmd_label, the phase left and entered,
    whether a file was edited before, u, amount (context left), context_runs_out (first time below a fifth), patience, odd_error."""
    df = readable(events)
    # a start stands beside its part's first event; where no trajectory is long, the join goes once Spark sees that there are none
    starts = part_starts(df)
    starts = starts.select(
        F.col("task_id").alias("__task"), F.col("part").alias("__part"), F.col("first_step").alias("__step"),
        F.struct(*[c for c in starts.columns if c not in ("task_id", "part", "first_step")]).alias("start"),
    )
    first = (F.col("task_id") == F.col("__task")) & (F.col("part") == F.col("__part")) & (F.col("step") - F.col("__step") == 0)
    both = df.join(starts, first, "left").select(*df.columns, "start")
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(fold.ADDED).fields])
    return worked_out(both.groupBy("task_id", "part").applyInArrow(fold.walked, schema))


def worked_out(walked: DataFrame) -> DataFrame:
    """Folded events with what their numbers mean."""
    label, command = _labels()
    context = F.col("type").isin("bash_call", "context_update")
    return walked.select(
        "task_id", "seq", "place", "step", "type", "outcome", "trigger", "left", "edited", "phase", "u", label.alias("label"), command.alias("cmd_label"),
        F.when(context, F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("used") / F.col("most")), 3)).alias("amount"),
        F.col("runs_out").alias("context_runs_out"), _patience().alias("patience"), (F.col("errors") % 2 == 0).alias("odd_error"),
    )


def constraint(kind: str, **fields: str) -> str:
    """SQL of a constraint struct; fields are SQL texts."""
    values = {"type": f"'{kind}'", "timestamp": "cast(step as bigint)"} | fields
    return "named_struct(" + ", ".join(f"'{n}', cast({values.get(n, 'null')} as {t})" for n, t in CONSTRAINT_FIELDS) + ")"


def _emitted() -> str:
    none = "array()"
    context = constraint("ResourceBudget", resource="'context_window'", amount="amount", decay="'monotone_decrease'")
    out = constraint("ToolAvailability", tool="'context_window'", state="'unavailable'")
    seen = constraint("InformationState", observable_added="array(label)", observable_removed="array()", uncertainty="round(u, 3)")
    depends = constraint(
        "CoordinationDependency", role="'affected_module_M1'", dependency="label", expected_action="concat('resolve_', label)"
    )
    move = lambda trigger: constraint("SubGoalTransition", from_phase="left", to_phase="phase", trigger=trigger)
    better = constraint("OptimizationCriterion", objective="'correctness_primary'", weight_shift="'correctness_increase'")
    worse = constraint("ResourceBudget", resource="'patience_budget'", amount="patience", decay="'monotone_decrease_if_turn_based'")
    broken = constraint("ToolAvailability", tool="'test_suite'", state="'unavailable'", recover_in="3")
    ready = constraint("ToolAvailability", tool="label", state="'available'")
    return f"""case
      when type in ('bash_call', 'context_update') then if(context_runs_out, array({context}, {out}), array({context}))
      when type = 'file_read' then array({seen})
      when type = 'file_edit' then if(not edited or left not in ('implementation', 'debugging'), array({move("'first_edit'")}), array({ready}))
      when type = 'test_run' and outcome = 'pass' then if(left <> 'validation', array({move("'test_pass'")}, {better}), array({better}))
      when type = 'test_run' then if(left <> 'debugging', array({move("'test_fail'")}, {worse}, {broken}), array({worse}, {broken}))
      when type = 'error_reveal' then if(odd_error, array({depends}), array({seen}))
      when type = 'task_transition' then array({move("substring(trigger, 1, 50)")})
      else {none} end"""


def constraints_of(folded_events: DataFrame) -> DataFrame:
    made = folded_events.select("task_id", "place", "phase", "cmd_label", F.posexplode(F.expr(_emitted())).alias("pos", "c"))
    return made.select("task_id", (F.col("place") + F.col("pos")).cast("int").alias("idx"), "c.*", "phase", "cmd_label")


def translate(events: DataFrame) -> DataFrame:
    """(task_id, idx, <constraint fields>, phase, cmd_label): one row a constraint, idx from 0; phase and command after it."""
    return constraints_of(folded(events))
