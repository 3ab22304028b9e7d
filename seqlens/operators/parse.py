"""Raw records to trajectories: format predicates, classification of turns, and events with dense steps.

Inputs are rows with a record id and nested arrays; outputs are events (task_id, step, type, command, path, framework, outcome,
tests_run, error_type, message, ...). Each parser explodes turns, makes event structs, and numbers them by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import stored

EVENT_FIELDS = [
    ("type", "string"),
    ("command", "string"),
    ("path", "string"),
    ("operation", "string"),
    ("framework", "string"),
    ("outcome", "string"),
    ("tests_run", "int"),
    ("error_type", "string"),
    ("message", "string"),
    ("from_phase", "string"),
    ("to_phase", "string"),
    ("reason", "string"),
    ("event_source", "string"),
    ("tokens_used", "bigint"),
    ("tokens_max", "bigint"),
]
MARK = "New Terminal Output:"
# Exit states and what counts as a right score.
PASSED, FAILED = ("submitted", "exit_cost", "exit_format"), ("early_exit", "exit_context", "autosubmission_failed")
RIGHT = ("correct", "pass", "true", "yes", "1", "c")


def event(kind: str | Column, **fields: Column) -> Column:
    values = {"type": F.lit(kind) if isinstance(kind, str) else kind} | fields
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVENT_FIELDS])


def error_event(output: Column, source: str | None = None) -> Column:
    return event("error_reveal", error_type=X.error_class(output), message=F.substring(output, 1, 300), event_source=F.lit(source))


def numbered(made: DataFrame, *order: str) -> DataFrame:
    """Rows (task_id, *order, e) to events with dense steps."""
    step = F.row_number().over(Window.partitionBy("task_id").orderBy(*order)) - 1
    return made.filter("e is not null").select("task_id", step.cast("int").alias("step"), "e.*")


def acts_to_events(acts: DataFrame, most: int = 200_000) -> DataFrame:
    """acts (task_id, i, j, patch, cmd, out, shown, tokens), in the order of i and j, to events with dense steps.

    A command is classified (patch: with editors' commands; shown: its output shows a test's result) and tests read their result
    from `out`, if it is not null. A row without a command is an error that `out` shows or, with tokens, a context update.
    Rows are numbered first, so that sorts carry no events, and all formats share one classification."""
    step = F.row_number().over(Window.partitionBy("task_id").orderBy("i", "j")) - 1
    df = acts.select("task_id", step.cast("int").alias("step"), "patch", "cmd", "out", "shown", "tokens")
    cmd, out, kind = F.col("cmd"), F.col("out"), F.col("kind")
    df = df.withColumn("kind", F.when(F.col("patch") & X.is_patch_edit(cmd), "file_edit").otherwise(X.classify_command(cmd)))
    tested = F.col("shown") & kind.isin("bash_call", "file_read")
    kind = F.when(F.col("tokens").isNotNull(), "context_update").when(cmd.isNull(), "error_reveal").when(tested, "test_run").otherwise(kind)
    df = df.withColumn("type", kind)
    kind = F.col("type")
    test, read, edit, error = kind == "test_run", kind == "file_read", kind == "file_edit", kind == "error_reveal"
    values = {
        "type": kind,
        "command": cmd,
        "path": F.when(read | edit, X.file_path(cmd)),
        "operation": F.when(edit, "modify"),
        "framework": F.when(test, X.framework(cmd)),
        "outcome": F.when(test & out.isNotNull(), X.test_outcome(out)),
        "tests_run": F.when(test, X.test_count(out)),
        "error_type": F.when(error, X.error_class(out)),
        "message": F.when(error, F.substring(out, 1, 300)),
        "tokens_used": F.col("tokens"),
        "tokens_max": F.when(F.col("tokens").isNotNull(), F.lit(most)),
    }
    return df.select("task_id", "step", *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVENT_FIELDS])


def act(j: Column | int = 0, patch: bool = False, cmd: Column | None = None, out: Column | None = None, shown: Column | None = None, tokens: Column | None = None) -> list[Column]:
    """The columns of an act but its record and turn."""
    none, j = F.lit(None), F.lit(j) if isinstance(j, int) else j
    text = lambda c: (none if c is None else c).cast("string")
    return [
        j.cast("int").alias("j"), F.lit(patch).alias("patch"), text(cmd).alias("cmd"), text(out).alias("out"),
        F.coalesce(none.cast("boolean") if shown is None else shown, F.lit(False)).alias("shown"), (none if tokens is None else tokens).cast("bigint").alias("tokens"),
    ]


# --- format predicates and outcomes ---------------------------------------------------------------------------------------


def is_terminal_format(record: Column) -> Column:
    """record: a JSON text whose "conversations" is a list."""
    return F.coalesce(F.startswith(F.trim(F.get_json_object(record, "$.conversations")), F.lit("[")), F.lit(False))


def is_role_text_format(record: Column) -> Column:
    first = F.get_json_object(record, "$.trajectory[0]")
    return F.coalesce(F.array_contains(F.json_object_keys(first), "text") & ~F.array_contains(F.json_object_keys(first), "action"), F.lit(False))


def is_chat_format(record: Column) -> Column:
    first = F.json_object_keys(F.get_json_object(record, "$.messages[0]"))
    both = F.array_contains(first, "role") & F.array_contains(first, "content")
    return F.coalesce(both & F.array_contains(F.json_object_keys(record), "instance_id"), F.lit(False))


def outcome_of_scores(scores: Column) -> Column:
    """scores: map of texts; any number of at least 1 or right word passes."""
    good = lambda v: (F.coalesce(v.try_cast("double"), F.lit(0.0)) >= 1.0) | F.lower(v).isin(*RIGHT)
    return F.when(F.exists(F.map_values(scores), lambda v: F.coalesce(good(v), F.lit(False))), "pass").otherwise("fail")


def outcome_of_info(status: Column, submission: Column, patch: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    made = (F.coalesce(submission, F.lit("")) != "") | (F.coalesce(patch, F.lit("")) != "")
    return F.when(s.isin(*PASSED), "pass").when(s.isin(*FAILED), "fail").when(made, "pass").otherwise("fail")


def command_of_arguments(arguments: Column, keys: Column | None = None) -> Column:
    """The first of the usual names, even if empty, else the first text value in the object's order; what is no object is the command.
    keys: the object's keys, where the caller has them; only names among them are looked up."""
    keys = F.json_object_keys(arguments) if keys is None else keys
    usual = [F.when(F.array_contains(keys, n), F.get_json_object(arguments, f"$.{n}")) for n in ("cmd", "command", "input", "bash_command", "code")]
    texts = F.filter(F.regexp_extract_all(arguments, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*"'), F.lit(1)), lambda k: F.array_contains(keys, k))
    anything = F.try_element_at(F.from_json(arguments, "map<string,string>"), F.try_element_at(texts, F.lit(1)))
    return X.py_strip(F.coalesce(F.when(keys.isNull(), arguments), *usual, anything, F.lit("")))


# --- records to events ----------------------------------------------------------------------------------------------------


def chat_events(records: DataFrame) -> DataFrame:
    """records: (task_id, messages array<struct<role, content, tool_calls array<struct<id, arguments>>, tool_call_id>>)."""
    turns = records.select("task_id", F.posexplode("messages").alias("i", "x")).select(
        "task_id", "i", "x.role", F.col("x.content").alias("text"), F.col("x.tool_calls").alias("calls"), F.col("x.tool_call_id").alias("call_id"), F.lit(None).cast("bigint").alias("tokens")
    )
    return acts_to_events(chat_acts(turns))


def chat_acts(turns: DataFrame) -> DataFrame:
    """turns (task_id, i, role, text, calls array<struct<id, arguments>>, call_id, tokens) to acts.

    Tool output gives the result of the test that has its call id: the latest call before it; later output wins."""
    entry = "struct<j:int,call_id:string,arguments:string,output:string>"
    named = lambda j, call_id, arguments, output: F.struct(j.cast("int").alias("j"), call_id.alias("call_id"), arguments.alias("arguments"), output.alias("output")).cast(entry)
    none = F.lit(None).cast("string")
    calls = F.transform("calls", lambda call, c: named(c, F.coalesce(call["id"], F.concat_ws("_", F.lit("call"), F.col("i").cast("string"), c.cast("string"))), F.coalesce(call["arguments"], F.lit("")), none))
    output = F.array(named(F.lit(0), F.col("call_id"), none, X.flatten_content(F.col("text"))))
    used = F.array(named(F.lit(0), none, none, none))
    each = F.when(F.col("tokens").isNotNull(), used).when(F.col("role") == "assistant", calls).when(F.col("role") == "tool", output)
    df = turns.select("task_id", "i", "tokens", F.explode(each).alias("x")).select("task_id", "i", "tokens", "x.*")
    # in the order of an id's messages each call opens a run, and the last output of the run is the call's: no join
    is_call = F.col("arguments").isNotNull()
    same = Window.partitionBy("task_id", "call_id").orderBy("i", "j")
    df = df.withColumn("run", F.count_if(is_call).over(same))
    run = Window.partitionBy("task_id", "call_id", "run").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("result", F.last("output", True).over(run)).filter(is_call | X.has_error(F.col("output")) | F.col("tokens").isNotNull())
    df = df.withColumn("keys", F.json_object_keys("arguments"))
    cmd = F.when(is_call, command_of_arguments(F.col("arguments"), F.col("keys")))
    return df.select("task_id", "i", *act(F.col("j"), cmd=cmd, out=F.when(is_call, F.col("result")).otherwise(F.col("output")), tokens=F.col("tokens")))


def step_events(records: DataFrame) -> DataFrame:
    """records: (task_id, traj array<struct<action, observation>>)."""
    steps = records.select("task_id", F.posexplode("traj").alias("i", "s"))
    return acts_to_events(step_acts(steps.select("task_id", "i", "s.action", "s.observation", F.lit(None).cast("bigint").alias("tokens"))))


def step_acts(steps: DataFrame) -> DataFrame:
    """steps (task_id, i, action, observation, tokens) to acts: a step's command, and the error that its output shows."""
    strip = lambda c: F.coalesce(X.stripped(c), F.lit(""))
    steps = steps.select("task_id", "i", strip(F.col("action")).alias("a"), strip(F.col("observation")).alias("o"), "tokens").filter("a <> '' or tokens is not null")
    steps = steps.withColumn("low", X.folded(F.col("o")))
    a, o, low, j, tokens = F.col("a"), F.col("o"), F.col("low"), F.col("j"), F.col("tokens")
    wrong = tokens.isNull() & (o != "") & X.has_error(o, low)
    # only numbers are exploded: who counts acts works out no more of them
    each = F.when(wrong, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = steps.select("task_id", "i", "a", "o", "low", "tokens", F.explode(each).alias("j"))
    own = j == 0
    return df.select("task_id", "i", *act(j, True, F.when(own & tokens.isNull(), a), o, own & (o != "") & X.observed(o, low), tokens))


def terminal_commands(content: Column) -> Column:
    """Commands in the JSON object that a turn holds."""
    body = F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit(""))
    items = F.from_json(F.get_json_object(body, "$.commands"), "array<string>")
    keys = F.transform(items, lambda x: X.py_strip(F.when(F.startswith(x, F.lit("{")), F.coalesce(F.get_json_object(x, "$.keystrokes"), F.lit(""))).otherwise(x)))
    return F.coalesce(F.filter(keys, lambda x: x != ""), F.array().cast("array<string>"))


def terminal_output(content: Column) -> Column:
    return F.when(content.contains(MARK), F.substr(content, F.locate(MARK, content) + len(MARK))).otherwise(content)


def terminal_events(records: DataFrame) -> DataFrame:
    """records: (task_id, conversations array<struct<role, content>>)."""
    turns = records.select("task_id", F.posexplode("conversations").alias("i", "t"))
    return acts_to_events(terminal_acts(turns.select("task_id", "i", "t.role", F.col("t.content").alias("text"), F.lit(None).cast("bigint").alias("tokens"))))


def terminal_acts(turns: DataFrame) -> DataFrame:
    """turns (task_id, i, role, text, tokens) to acts: an assistant's commands, the last with the output that the user's next turn
    shows, and the errors in users' turns."""
    w = Window.partitionBy("task_id").orderBy("i")
    df = turns.select("task_id", "i", F.when(F.col("tokens").isNull(), F.coalesce("role", F.lit("user"))).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "tokens")
    first = F.first("role").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next"), (first == "user").cast("int").alias("start")).filter("i >= start or tokens is not null")
    assistant = F.col("role") == "assistant"
    said = F.when(assistant, F.when(F.col("next_role") == "user", X.py_strip(terminal_output(F.col("next")))).otherwise("")).when(F.col("role") == "user", terminal_output(F.col("text")))
    df = df.select("task_id", "i", "role", "start", "tokens", said.alias("out"), F.when(assistant, terminal_commands(F.col("text"))).alias("cmds"))
    out, last = F.col("out"), F.size("cmds") - 1
    shows = F.col("out").rlike(X.TERMINAL_PASS) | F.col("out").rlike(X.TERMINAL_FAIL)
    df = df.filter((F.size("cmds") > 0) | ((F.col("role") == "user") & (F.col("i") > F.col("start")) & X.has_error(out)) | F.col("tokens").isNotNull())
    df = df.withColumn("shows", F.when(assistant, shows))
    one = F.array(F.struct(*act(out=out, tokens=F.col("tokens"))))
    many = F.transform("cmds", lambda c, j: F.struct(*act(j, cmd=c, out=F.col("out"), shown=F.col("shows") & (j == last))))
    return df.select("task_id", "i", F.explode(F.when(assistant, many).otherwise(one)).alias("x")).select("task_id", "i", "x.*")


def terminal_outcomes(records: DataFrame) -> DataFrame:
    """(task_id, outcome): the last assistant turn's completion flag, else the last result that a user turn shows, else fail."""
    turns = records.select("task_id", F.posexplode("conversations").alias("i", "t"))
    body = F.nullif(F.regexp_extract(F.coalesce("t.content", F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    flag = F.coalesce(F.get_json_object(body, "$.is_task_complete"), F.lit("false"))
    out = terminal_output(F.coalesce(F.col("t.content"), F.lit("")))
    shown = F.when(F.col("t.role") == "user", F.when(out.rlike(X.TERMINAL_PASS), "pass").when(out.rlike(X.TERMINAL_FAIL), "fail"))
    df = turns.select("task_id", "i", F.col("t.role").alias("role"), (~flag.isin("false", "null", "0", "", "[]", "{}")).alias("flag"), shown.alias("shown"))
    got = df.groupBy("task_id").agg(
        F.max_by("flag", F.when(F.col("role") == "assistant", F.col("i"))).alias("done"),
        F.max_by("shown", F.when(F.col("shown").isNotNull(), F.col("i"))).alias("shown"),
    )
    return got.select("task_id", F.when(F.coalesce("done", F.lit(False)), "pass").otherwise(F.coalesce("shown", F.lit("fail"))).alias("outcome"))


def pending_actions(turns: DataFrame, agent: str, action: Column) -> DataFrame:
    """turns (task_id, i, role, text): an agent's action waits for the user's next turn, which emits it; a later one replaces it.
    action: null leaves what waits as it is. (task_id, i, action, observation)."""
    w = Window.partitionBy("task_id").orderBy("i")
    df = turns.withColumn("__a", F.when(F.col("role") == agent, action))
    waits = F.last(F.when(F.col("__a").isNotNull(), F.struct("i", "__a")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    emitted = F.max(F.when(F.col("role") == "user", F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.select("*", waits.alias("__w"), emitted.alias("__u"))
    df = df.filter("role = 'user' and __w is not null and (__u is null or __w.i > __u)")
    return df.select("task_id", "i", F.col("__w.__a").alias("action"), F.col("text").alias("observation"))


def role_text_action() -> Column:
    """The fence's body, else the last line; empty is none."""
    return X.nonempty(F.coalesce(X.fenced_action(F.col("text")), X.last_line(F.col("text"))))


def chat_action() -> Column:
    """The fence's body (even empty), else the whole text; empty is none."""
    return F.coalesce(X.fenced_action(F.col("text")), X.truthy(X.stripped(F.col("text"))))


def as_steps(pairs: DataFrame) -> DataFrame:
    """Pairs to records of step_events."""
    return pairs.groupBy("task_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "action", "observation"))), lambda x: F.struct(x["action"].alias("action"), x["observation"].alias("observation"))).alias("traj")
    )


def markdown_turns(sessions: DataFrame) -> DataFrame:
    """sessions (task_id, content) to (task_id, i, role, text): text before the first header is dropped."""
    roles = F.regexp_extract_all("content", F.lit(X.TURN_HEADER), F.lit(1))
    bodies = F.split("content", X.TURN_HEADER)
    pairs = F.arrays_zip(roles.alias("role"), F.expr("slice(__b, 2, greatest(size(__b) - 1, 0))").alias("text"))
    df = sessions.withColumn("__b", bodies).select("task_id", F.posexplode(pairs).alias("i", "t"))
    return df.select("task_id", "i", F.lower("t.role").alias("role"), X.py_strip(F.col("t.text")).alias("text"))


def user_event() -> Column:
    t = F.col("text")
    return (
        F.when(X.py_strip(t) == "", F.lit(None))
        .when(t.rlike(X.HUMAN_ERROR), error_event(t, "user_paste"))
        .when(t.rlike(X.CODE_FENCE), event("file_read", command=F.lit("paste_code"), path=X.file_reference(t), event_source=F.lit("user_paste")))
        .otherwise(event("task_transition", from_phase=F.lit("unknown"), to_phase=F.lit("unknown"), reason=X.first_line(t), event_source=F.lit("user_request")))
    )


def assistant_event() -> Column:
    t = F.col("text")
    cmd = X.shell_command(t)
    test = event(
        "test_run", command=cmd, framework=X.human_framework(cmd), outcome=F.when(t.rlike(X.HUMAN_PASS), "pass").otherwise("fail"),
        event_source=F.lit("assistant_command"),
    )
    return (
        F.when(X.py_strip(t) == "", F.lit(None))
        .when((cmd != "") & cmd.rlike(X.HUMAN_TEST), test)
        .when(cmd != "", event("bash_call", command=cmd, event_source=F.lit("assistant_command")))
        .when(
            t.rlike(X.CODE_FENCE),
            event("file_edit", command=F.lit("apply_generated_code"), path=X.file_reference(t), operation=F.lit("modify"), event_source=F.lit("assistant_codegen")),
        )
        .otherwise(event("bash_call", command=F.concat(F.lit("explain: "), X.first_line(t)), event_source=F.lit("assistant_text")))
    )


def session_events(turns: DataFrame) -> DataFrame:
    """turns (task_id, i, role, text): user and human turns, and those of assistants; system turns are left out."""
    made = F.when(F.col("role").isin("user", "human"), user_event()).when(F.col("role").isin("assistant", "agent", "ai", "copilot"), assistant_event())
    return numbered(turns.select("task_id", "i", made.alias("e")), "i")


def session_outcomes(events: DataFrame) -> DataFrame:
    """The last test's outcome, else pass."""
    last = F.max_by("outcome", F.when(F.col("type") == "test_run", F.col("step")))
    return events.groupBy("task_id").agg(F.coalesce(last, F.lit("pass")).alias("outcome"))


def with_usage(events: DataFrame, usage: DataFrame, most: int = 200_000) -> DataFrame:
    """usage (task_id, tokens): where positive, a context update follows the last event."""
    n = events.groupBy("task_id").agg((F.max("step") + 1).alias("step"))
    more = usage.filter("tokens > 0").join(n, "task_id", "left")
    rows = more.select("task_id", F.coalesce("step", F.lit(0)).alias("step"), event("context_update", tokens_used=F.col("tokens"), tokens_max=F.lit(most)).alias("e"))
    return events.unionByName(rows.select("task_id", "step", "e.*"))


# --- admission ------------------------------------------------------------------------------------------------------------


def admitted(events: DataFrame, outcomes: DataFrame, least: int = 15) -> DataFrame:
    """Task ids with enough events and a known outcome."""
    n = events.groupBy("task_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.join(outcomes.filter(F.col("outcome").isin("pass", "fail")), "task_id").select("task_id", "n", "outcome")


def first_accepted(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each content key: the first accepted in scan order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def accept_new(df: DataFrame, path: str, key: str, order: list[str], accepted: Column) -> DataFrame:
    """The rows that a run accepts: of each content key the first for which `accepted` holds, unless an earlier run has accepted it.
    Their keys are appended to the table at path, by the first character of the key; rows that were rejected are judged again."""
    spark = df.sparkSession
    schema = f"{key} {df.schema[key].dataType.simpleString()}, head string"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("head").parquet(path)
    known = spark.read.schema(schema).parquet(path)
    fresh = df.filter(accepted).withColumn("head", F.substring(F.col(key).cast("string"), 1, 1))
    out = stored(first_accepted(fresh.join(known, ["head", key], "left_anti"), key, order), "accepted")
    out.select(key, "head").write.mode("append").partitionBy("head").parquet(path)
    return out.select(*df.columns)
