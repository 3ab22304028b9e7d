"""Sequence compression: gaps and islands over the ordered events of a trajectory.

Events are rows (task_id, step, type, command, path, message, reason, ...). All windows share the partitioning by task_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Commands that do nothing, and the length of a burst of reads.
NOOPS = ("ls", "ls -la", "ls -l", "ls -a", "ls -lh", "pwd", "whoami", "echo", "date", "hostname", "true", ":")
BURST = 3
MESSAGE = 120


def order():
    return Window.partitionBy("task_id").orderBy("step")



def command() -> Column:
    return py_strip(F.coalesce("command", F.lit("")))


def is_noop() -> Column:
    return (F.col("type") == "bash_call") & command().isin(*NOOPS)


def keep_noops() -> Column:
    """A no-op stays only before a read, edit or command that is itself no no-op."""
    follows = F.lead("type").over(order()).isin("file_read", "file_edit", "bash_call") & ~F.lead(is_noop()).over(order())
    return ~is_noop() | F.coalesce(follows, F.lit(False))


def repeats(kind: str, value: Column, empty_too: bool = True) -> Column:
    """The event before is of the same kind and value."""
    same = (F.col("type") == kind) & (F.lag("type").over(order()) == kind) & (F.lag(value).over(order()) == value)
    return F.coalesce(same if empty_too else same & (value != ""), F.lit(False))


def _drop(df: DataFrame, keep: Column) -> DataFrame:
    return df.withColumn("__keep", keep).filter("__keep").drop("__keep")


def path() -> Column:
    return F.coalesce("path", F.lit(""))


def compress_terminal(df: DataFrame) -> DataFrame:
    df = _drop(df, keep_noops())
    df = _drop(df, ~repeats("bash_call", command()))
    return _drop(df, ~repeats("file_read", path(), empty_too=False))


def read_bursts(df: DataFrame, least: int = BURST) -> DataFrame:
    """A run of `least` reads or more becomes one event that lists the other paths."""
    read = F.col("type") == "file_read"
    kinds = Window.partitionBy("task_id", "__read").orderBy("step")
    df = df.withColumn("__read", read).withColumn("__run", F.row_number().over(order()) - F.row_number().over(kinds))
    run = Window.partitionBy("task_id", "__read", "__run").orderBy("step")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("__size", F.when(F.col("__read"), F.count("*").over(whole)).otherwise(F.lit(1)))
    df = df.withColumn("__paths", F.when(F.col("__size") >= least, F.collect_list(path()).over(whole))).withColumn("__place", F.row_number().over(run))
    burst = F.col("__size") >= least
    df = df.filter(~burst | (F.col("__place") == 1))
    df = df.withColumn("command", F.when(burst, "read_burst").otherwise(F.col("command")))
    df = df.withColumn("burst_size", F.when(burst, F.col("__size").cast("int")))
    df = df.withColumn("additional_paths", F.when(burst, F.expr("slice(__paths, 2, greatest(size(__paths) - 1, 0))")))
    return df.drop("__read", "__run", "__size", "__paths", "__place")


def retry_runs(df: DataFrame) -> DataFrame:
    """Consecutive commands that are the same become one with the number of tries."""
    df = df.withColumn("__new", (~repeats("bash_call", command())).cast("int"))
    df = df.withColumn("__run", F.sum("__new").over(order()))
    tries = F.count("*").over(Window.partitionBy("task_id", "__run"))
    df = df.withColumn("__tries", tries).filter("__new = 1")
    return df.withColumn("retry_count", F.when(F.col("__tries") > 1, F.col("__tries").cast("int"))).drop("__new", "__run", "__tries")


def short_messages(df: DataFrame, most: int = MESSAGE) -> DataFrame:
    return df.withColumn("message", F.when(F.col("type") == "error_reveal", F.substring("message", 1, most)).otherwise(F.col("message")))


def compress_patch(df: DataFrame) -> DataFrame:
    return short_messages(retry_runs(read_bursts(df)))


def compress_human(df: DataFrame) -> DataFrame:
    df = _drop(df, ~repeats("task_transition", F.coalesce("reason", F.lit(""))))
    return _drop(df, ~repeats("file_edit", path(), empty_too=False))


COMPRESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {"tb": compress_terminal, "swe": compress_patch, "human": compress_human}


def compress(df: DataFrame, source: str) -> DataFrame:
    if source not in COMPRESSORS:
        raise ValueError(f"Unknown source: {source}")
    return COMPRESSORS[source](df)


def compression_log(df: DataFrame, source: str = "tb") -> DataFrame:
    """What compression drops, merges or shortens and why: (task_id, step, reason, line)."""
    if source not in LOGGED:
        raise ValueError(f"Unknown source: {source}")
    return LOGGED[source](df).select("task_id", "step", "reason", F.format_string(f"[{source}] step %d: %s", "step", "reason").alias("line"))


def _steps(df: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
    """The rows that each step drops from what those before have left, with its reason."""
    out = None
    for reason, dropped in steps:
        df = df.withColumn("__gone", dropped)
        gone = df.filter("__gone").select("task_id", "step", F.lit(reason).alias("reason"))
        out, df = gone if out is None else out.unionByName(gone), df.filter("not __gone").drop("__gone")
    return out


def _terminal_log(df: DataFrame) -> DataFrame:
    return _steps(df, ("no_op", ~keep_noops()), ("repeated_command", repeats("bash_call", command())), ("repeated_read", repeats("file_read", path(), False)))


def _patch_log(df: DataFrame) -> DataFrame:
    short = read_bursts(df)
    long = (F.col("type") == "error_reveal") & (F.length("message") > MESSAGE)
    reason = F.when(F.col("burst_size").isNotNull(), "read_burst").when(repeats("bash_call", command()), "retry").when(long, "short_message")
    return short.withColumn("reason", reason).filter("reason is not null")


def _human_log(df: DataFrame) -> DataFrame:
    again = repeats("task_transition", F.coalesce("reason", F.lit("")))
    return _steps(df, ("repeated_transition", again), ("merged_edit", repeats("file_edit", path(), empty_too=False)))


LOGGED: dict[str, Callable[[DataFrame], DataFrame]] = {"tb": _terminal_log, "swe": _patch_log, "human": _human_log}
