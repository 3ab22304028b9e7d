"""Heterogeneous raw records (JSON texts) to trajectories: one plan with a branch for each format.

records: (key, record), key unique. Formats: terminal (conversations), role_text (trajectory of role/text turns), resolved
(chat messages with an instance_id), steps (traj or trajectory of action/observation), chat (messages with tool calls).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..storage import bucketed, stored
from . import parse as P

_TURNS = "array<struct<role:string,content:string>>"
_TEXTS = "array<struct<role:string,text:string>>"
_STEPS = "array<struct<action:string,observation:string>>"
_TURN = [("role", "string"), ("text", "string"), ("action", "string"), ("calls", "array<struct<id:string,arguments:string>>"), ("call_id", "string"), ("tokens", "bigint")]
_CHAT = (
    "array<struct<role:string,content:string,tool_calls:array<struct<id:string,arguments:string,function:struct<arguments:string>>>,tool_call_id:string>>"
)
R = "record"
# The top-level values that are read.
_TOP = (
    "conversations trajectory traj messages instance_id id task_id sample_id task trial_name run_id output model eval model_name_or_path"
    " model_name selected_models agent metadata stats info scores resolved exit_status target"
).split()


def opened(records: DataFrame) -> DataFrame:
    """(key, record, first, named): instead of each record's text the texts of its top-level values, which are read in one pass; the
    keys of the first item of its trajectory, else messages; whether it has an instance_id, even null. A record of which that
    pass gives nothing (one with a value that can't be written, say) is asked for each value on its own."""
    df = records.select("key", R, F.json_tuple(R, *_TOP).alias(*[f"__{n}" for n in _TOP]))
    found = F.coalesce(*[f"__{n}" for n in _TOP]).isNotNull()
    df = df.select("key", F.col(R).alias("__whole"), F.struct(*[F.when(found, F.col(f"__{n}")).otherwise(F.get_json_object(R, f"$.{n}")).alias(n) for n in _TOP]).alias(R))
    trajectory, messages = value("trajectory"), value("messages")
    keys = lambda c: F.json_object_keys(F.get_json_object(c, "$[0]"))
    first = F.when(is_list(trajectory), keys(trajectory)).when(is_list(messages), keys(messages))
    named = value("instance_id").isNotNull() | F.coalesce(F.array_contains(F.json_object_keys("__whole"), "instance_id"), F.lit(False))
    return df.select("key", R, first.alias("first"), named.alias("named"))


def value(path: str) -> Column:
    """The text at a path of an opened record."""
    top, _, rest = path.partition(".")
    return F.get_json_object(f"{R}.{top}", f"$.{rest}") if rest else F.col(f"{R}.{top}")


def field(*paths: str) -> Column:
    """The first of the paths that is neither missing nor empty."""
    return F.coalesce(*[truthy(value(p)) for p in paths])


def is_list(c: Column) -> Column:
    return F.coalesce(F.startswith(F.trim(c), F.lit("[")), F.lit(False))


def record_format(terminal: bool) -> Column:
    """terminal: records of the terminal source, which are conversations or chat samples; else those of the patch source."""
    if terminal:
        return F.when(is_list(value("conversations")), "terminal").when(is_list(value("messages")) | value("messages").isNull(), "chat")
    has = lambda k: F.coalesce(F.array_contains("first", k), F.lit(False))
    tools = F.get_json_object(value("messages"), "$[*].tool_calls")
    return (
        F.when(is_list(value("trajectory")) & has("text") & ~has("action"), "role_text")
        .when(is_list(value("traj")), "steps")
        .when(is_list(value("trajectory")), F.when(has("action"), "steps").otherwise("chat"))
        .when(has("role") & has("content") & F.col("named") & ~is_list(tools), "resolved")
        .when(is_list(value("messages")), "chat")
    )


def usage_tokens(value: Callable[[str], Column] = lambda path: F.get_json_object(R, f"$.{path}")) -> Column:
    """Tokens of the first usage block that is there; or what was sent and received. value: the text at a path."""
    blocks = ("metadata.usage", "metadata.token_usage", "output.usage", "stats.model_usage")
    block = F.coalesce(*[F.nullif(value(b), F.lit("{}")) for b in blocks])
    number = lambda c, p: F.nullif(F.get_json_object(c, p).try_cast("bigint"), F.lit(0))
    named = F.coalesce(*[number(block, f"$.{n}") for n in ("input_tokens", "total_tokens", "prompt_tokens")])
    stat = lambda n: F.coalesce(value(f"info.model_stats.{n}").try_cast("bigint"), F.lit(0))
    return F.coalesce(named, F.nullif(stat("tokens_sent") + stat("tokens_received"), F.lit(0)), F.lit(0))


def heads(records: DataFrame, terminal: bool) -> DataFrame:
    """(key, record, format, name, model, agent): records opened; format is null where a record has no known one."""
    name = field("task", "trial_name", "run_id") if terminal else field("instance_id", "id", "task_id")
    if terminal:
        name = F.when(F.col("format") == "chat", field("id", "task_id", "sample_id")).otherwise(name)
    model = field("output.model", "model", "eval.model") if terminal else F.coalesce(field("model_name_or_path", "model_name"), truthy(F.get_json_object(value("selected_models"), "$[0]")), field("model"))
    agent = F.coalesce(field("agent"), F.when(F.col("format") == "terminal", "terminus").otherwise("inspect-ai" if terminal else "swe-agent"))
    df = opened(records).withColumn("format", record_format(terminal))
    return df.select("key", R, "format", F.coalesce(name, F.lit("unknown")).alias("name"), F.coalesce(model, F.lit("unknown")).alias("model"), agent.alias("agent"))


def outcomes(head: DataFrame) -> DataFrame:
    """(task_id, outcome) by the rule of each format."""
    score = lambda v: F.when(
        F.startswith(v, F.lit("{")), F.coalesce(*[F.get_json_object(v, f"$.{n}") for n in ("value", "score", "answer")])
    ).otherwise(v)
    scores = F.transform_values(F.from_json(value("scores"), "map<string,string>"), lambda k, v: score(v))
    scored = F.coalesce(P.outcome_of_scores(scores), F.lit("fail"))
    info = P.outcome_of_info(field("info.exit_status"), field("info.submission"), field("info.model_patch"))
    resolved = value("resolved")
    flag = F.when(resolved == "true", "pass").when(resolved == "false", "fail").when(F.lower(F.coalesce(field("exit_status"), F.lit(""))).contains("submitted"), "pass").otherwise("fail")
    target = F.when(value("target").isin("true", "1"), "pass").otherwise("fail")
    chat = F.when(value("scores").isNotNull() | value("info").isNull(), scored).otherwise(info)
    rule = F.when(F.col("format") == "steps", info).when(F.col("format") == "resolved", flag).when(F.col("format") == "role_text", target).when(F.col("format") == "chat", chat)
    talks = head.filter("format = 'terminal'").select(F.col("key").alias("task_id"), F.from_json(value("conversations"), _TURNS).alias("conversations"))
    return head.filter("format <> 'terminal'").select(F.col("key").alias("task_id"), rule.alias("outcome")).unionByName(P.terminal_outcomes(talks))


def turns(head: DataFrame) -> DataFrame:
    """(task_id, format, i, role, text, action, calls, call_id, tokens): the turns or steps of records of all formats (a step's
    output is its text) and after them the usage, if there is one. Records are parsed once; their turns are dealt by task_id and
    kept apart by format, so that each format's parser reads its own."""
    made = lambda **c: F.struct(*[c.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TURN])
    body = lambda kind, *paths: F.from_json(F.coalesce(*map(value, paths)), kind)
    said = lambda name: lambda x: made(role=x["role"], text=x[name])
    call = lambda c: F.struct(c["id"].alias("id"), F.coalesce(c["arguments"], c["function"]["arguments"]).alias("arguments"))
    message = lambda x: made(role=x["role"], text=x["content"], calls=F.transform(x["tool_calls"], call), call_id=x["tool_call_id"])
    is_format = lambda f: F.col("format") == f
    every = (
        F.when(is_format("terminal"), F.transform(body(_TURNS, "conversations"), said("content")))
        .when(is_format("role_text"), F.transform(body(_TEXTS, "trajectory"), said("text")))
        .when(is_format("resolved"), F.transform(body(_TURNS, "messages"), said("content")))
        .when(is_format("steps"), F.transform(body(_STEPS, "traj", "trajectory"), lambda x: made(action=x["action"], text=x["observation"])))
        .when(is_format("chat"), F.transform(body(_CHAT, "messages", "trajectory"), message))
    )
    df = head.select(F.col("key").alias("task_id"), "format", every.alias("t"), F.when(F.col("format").isNotNull(), usage_tokens(value)).alias("tokens"))
    none = F.array().cast(every_type := "array<struct<" + ",".join(f"{n}:{t}" for n, t in _TURN) + ">>")
    used = F.when(F.col("tokens") > 0, F.array(made(tokens=F.col("tokens")))).otherwise(none)
    df = df.select("task_id", "format", F.posexplode(F.concat(F.coalesce(F.col("t").cast(every_type), none), used)).alias("i", "x")).select("task_id", "format", "i", "x.*")
    return bucketed(df, "turns", ["task_id"], ["task_id", "i"], ["format"])


def acts(head: DataFrame) -> DataFrame:
    """Acts of all records with a known format, one an event, keyed by task_id = key."""
    df = turns(head)
    part = lambda *f: df.filter(F.col("format").isin(*f))
    text, usage = F.coalesce("text", F.lit("")).alias("text"), F.col("tokens").isNotNull()
    none = F.lit(None).cast("bigint").alias("tokens")
    waiting = lambda f, agent, action: P.pending_actions(part(f).select("task_id", "i", "role", text), agent, action).select("*", none)
    steps = part("steps").select("task_id", "i", "action", F.col("text").alias("observation"), "tokens")
    used = part("role_text", "resolved").filter(usage).select("task_id", "i", "action", F.col("text").alias("observation"), "tokens")
    parts = [
        P.terminal_acts(part("terminal")),
        P.step_acts(steps),
        P.step_acts(waiting("role_text", "ai", P.role_text_action())),
        P.step_acts(waiting("resolved", "assistant", P.chat_action())),
        P.step_acts(used),
        P.chat_acts(part("chat")),
    ]
    return reduce(DataFrame.unionByName, parts)


def events(head: DataFrame) -> DataFrame:
    """Events of all records with a known format, keyed by task_id = key."""
    return P.acts_to_events(acts(head))


def trajectories(records: DataFrame, terminal: bool, least: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted heads with outcome, their events, rejected records with a reason). Each act is an event: records are judged by
    the number of their acts, and only those of admitted ones become events, once these are read."""
    head = stored(heads(records, terminal), "heads")
    good = head.filter("format is not null")
    made = acts(good)
    ok = stored(P.admitted(made, outcomes(good), least), "admitted")
    ok = ok.hint("merge")  # its file looks small, its rows grow with the records
    kept = good.drop(R).join(ok.withColumnRenamed("task_id", "key"), "key")
    lost = head.join(ok.select(F.col("task_id").alias("key")), "key", "left_anti")
    reason = F.when(F.col("format").isNull(), "no_format").otherwise("filter_fail").alias("reason")
    return kept, P.acts_to_events(made.join(ok.select("task_id"), "task_id", "left_semi")), lost.select("key", "name", reason)


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n in scan order."""
    return df.orderBy(*order).limit(n)


def gate(counts: DataFrame, least: int) -> None:
    """Raises unless the one number of `counts` reaches the target."""
    got = counts.first()[0]
    if got < least:
        raise ValueError(f"gate not passed: {got} of {least}")


def gates(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """(gate, got, least, passed) of the numbers in the one row of `counts`; a number that is missing counts as none."""
    each = [F.struct(F.lit(g).alias("gate"), F.coalesce(F.col(g).cast("bigint"), F.lit(0)).alias("got"), F.lit(n).cast("bigint").alias("least")) for g, n in least.items()]
    return counts.select(F.explode(F.array(*each)).alias("g")).select("g.*", (F.col("g.got") >= F.col("g.least")).alias("passed"))


def with_licence(df: DataFrame, known: DataFrame, repo: str = "repo") -> DataFrame:
    """df with the licence that the table of earlier look-ups (repo, licence) has for its repository, null where it has none; of
    several entries of a repository the least counts."""
    memo = known.groupBy(repo).agg(F.min("licence").alias("licence"))
    return df.join(memo, repo, "left")
