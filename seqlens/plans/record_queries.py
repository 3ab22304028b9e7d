"""Queries that parse raw records built from the driver's tables, with oracle SQL that states what must come out.

Each event of a user becomes a command with an output (samples.py); users' records take every known format in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import parse as P
from ..operators import records as R
from ..storage import stored
from . import samples as E
from .adapters import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def pick(rows: list[tuple], column: int, index: Column) -> Column:
    """That column of the sample rows, by number."""
    return F.element_at(F.array(*[F.lit(r[column]) for r in rows]), (index % len(rows)).cast("int") + 1)


def quoted(c: Column) -> Column:
    """A text as JSON, worked out once."""
    return F.rtrim(F.substr(F.to_json(F.struct(c.alias("x"))), F.lit(6)), F.lit("}"))


def joined(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))


def fields(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of values that are JSON; what is null is left out."""
    parts = [F.concat(F.lit(f'"{n}":'), v) for n, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def sampled(spark, d) -> DataFrame:
    """(u, s, k, cmd, out): a user's commands in order. Dealt by number, so that adaptive execution leaves no core without users."""
    df = table(spark, d, "events").select(F.col("user_id").alias("u"), "ts", "event_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    s = F.row_number().over(Window.partitionBy("u").orderBy("ts", "event_id")) - 1
    df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "u")
    return df.withColumn("s", s).select("u", "s", "k", pick(E.COMMANDS, 0, F.col("k")).alias("cmd"), pick(E.OUTPUTS, 0, F.floor(F.col("k") / 5)).alias("out"))


def turns(rows: DataFrame, *made: Column) -> DataFrame:
    """(u, n, turns): the JSON of each user's turns in order, some an event."""
    # made beside the groups: in an aggregate's arguments every repeated part is worked out each time
    rows = rows.select("u", F.struct("s", F.array(*made).alias("t")).alias("item"))
    df = rows.groupBy("u").agg(F.sort_array(F.collect_list("item")).alias("x"), F.count("*").alias("n"))
    return df.select("u", "n", F.flatten(F.transform("x", lambda x: F.filter(x["t"], lambda y: y.isNotNull()))).alias("turns"))


def tool_messages() -> tuple[Column, Column]:
    """A call whose arguments come in five shapes, and its output in three."""
    k, cmd = F.col("k"), F.col("cmd")
    args = (
        F.when(k % 5 == 0, fields(("cmd", quoted(cmd))))
        .when(k % 5 == 1, fields(("command", quoted(cmd))))
        .when(k % 5 == 2, fields(("code", quoted(F.lit("zzz"))), ("input", quoted(cmd))))
        .when(k % 5 == 3, cmd)
        .otherwise(fields(("timeout", F.lit("5")), ("script", quoted(cmd)), ("z", quoted(F.lit("no")))))
    )
    call_id = quoted(F.concat(F.lit("c"), F.col("s").cast("string")))
    call = fields(("id", call_id), ("function", fields(("arguments", quoted(args)))))
    out = quoted(F.col("out"))
    content = F.when(k % 3 == 0, out).when(k % 3 == 1, joined(F.array(fields(("type", quoted(F.lit("text"))), ("text", out))))).otherwise(joined(F.array(out)))
    return (
        fields(("role", quoted(F.lit("assistant"))), ("content", quoted(F.lit(""))), ("tool_calls", joined(F.array(call)))),
        fields(("role", quoted(F.lit("tool"))), ("tool_call_id", call_id), ("content", content)),
    )


def message(role: str, text: Column, name: str = "content") -> Column:
    return fields(("role", quoted(F.lit(role))), (name, quoted(text)))


def choice(n: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), n.cast("int") + 1)


def named(prefix: str) -> Column:
    return quoted(F.concat(F.lit(prefix), F.col("u").cast("string")))


def terminal_records(spark, d) -> DataFrame:
    """(key, record): conversations of even users, chat samples of odd ones."""
    ev = sampled(spark, d).withColumn("last", F.col("s") == F.max("s").over(Window.partitionBy("u")))
    done = F.when(F.col("last") & (F.col("u") % 3 == 0), "true").otherwise("false")
    plan = F.concat(F.lit("Plan: "), fields(("commands", joined(F.array(fields(("keystrokes", quoted(F.lit("echo start\n")))), quoted(F.col("cmd"))))), ("is_task_complete", done)))
    shown = F.when(F.col("k") % 2 == 0, F.concat(F.lit("x New Terminal Output:\n"), F.col("out"))).otherwise(F.col("out"))
    talks = turns(ev.filter("u % 2 = 0"), message("assistant", plan), message("user", shown))
    task = F.when(F.col("u") % 4 == 0, named("t"))
    first = F.array(message("user", F.lit("KeyError: the task")))
    talks = talks.select(
        F.col("u").alias("key"), fields(("task", task), ("trial_name", named("r")), ("model", quoted(F.lit("m0"))), ("conversations", joined(F.concat(first, "turns")))).alias("record")
    )
    chats = turns(ev.filter("u % 2 = 1"), *tool_messages())
    n = F.floor(F.col("u") / 2)
    scores = choice(n % 5, '{"acc":{"value":1.0}}', '{"acc":"C"}', '{"acc":0}', "{}", '{"a":{"score":0.2},"b":"yes"}')
    tokens = (F.col("u") + 100).cast("string")
    usage = n % 4
    some = lambda at, name, inner: (name, F.when(usage == at, inner))
    chats = chats.select(
        F.col("u").alias("key"),
        fields(
            ("id", F.when(F.col("u") % 3 == 0, named("a"))),
            ("sample_id", named("b")),
            some(0, "metadata", fields(("usage", fields(("input_tokens", tokens))))),
            some(1, "output", fields(("model", quoted(F.lit("m1"))), ("usage", fields(("total_tokens", tokens))))),
            some(3, "stats", fields(("model_usage", fields(("prompt_tokens", tokens))))),
            ("scores", scores),
            ("messages", joined(F.concat(F.array(message("system", F.lit("KeyError: s"))), "turns"))),
        ).alias("record"),
    )
    return stored(talks.unionByName(chats), "terminal-records")


def patch_records(spark, d) -> DataFrame:
    """(key, record): steps, role and text, resolved messages, or tool calls, by the user's number."""
    ev = sampled(spark, d)
    k, cmd, out = F.col("k"), F.col("cmd"), F.col("out")
    part = lambda n: ev.filter(f"u % 4 = {n}")
    q = F.floor(F.col("u") / 4) % 4
    status = choice(q, "submitted", "exit_context", "other", "other")
    stats = fields(("tokens_sent", F.col("u").cast("string")), ("tokens_received", F.lit("5")))
    info = fields(("exit_status", quoted(status)), ("model_patch", F.when(q == 2, quoted(F.lit("diff")))), ("model_stats", stats))
    step = fields(("action", quoted(F.concat(F.lit(" "), cmd))), ("observation", quoted(out)))
    blank = F.when(k % 9 == 0, fields(("action", quoted(F.lit("  "))), ("observation", quoted(out))))
    steps = turns(part(0), blank, step).withColumn("record", fields(("instance_id", named("i")), ("model_name_or_path", quoted(F.lit("pm"))), ("traj", joined(F.col("turns"))), ("info", info)))
    said = F.when(k % 3 == 0, F.concat(F.lit("So:\n```\n"), cmd, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Let me run\n\n "), cmd, F.lit("\n"))).otherwise(F.concat(F.lit("```bash\n"), cmd, F.lit("\n```\nwell")))
    before = F.when(k % 7 == 0, message("ai", F.lit("ls -la"), "text"))
    texts = turns(part(1), before, message("ai", said, "text"), message("user", out, "text"), F.when(k % 5 == 0, message("user", F.lit("and?"), "text")))
    opening = F.array(message("system", F.lit("s"), "text"), message("user", F.lit("task"), "text"))
    target = choice(q % 2, "true", "false")
    texts = texts.withColumn("record", fields(("instance_id", named("i")), ("model_name", quoted(F.lit("nm"))), ("target", target), ("trajectory", joined(F.concat(opening, "turns")))))
    content = F.when(k % 3 == 0, F.concat(F.lit("So:\n```\n"), cmd, F.lit("\n```"))).otherwise(F.concat(F.lit(" "), cmd, F.lit("\n")))
    talks = turns(part(2), message("assistant", content), message("user", out))
    resolved = choice(q, "true", "false", None, None)
    exited = choice(q, "early", "submitted", "Submitted (x)", "gone")
    talks = talks.withColumn(
        "record", fields(("instance_id", named("i")), ("selected_models", joined(F.array(quoted(F.lit("sm"))))), ("resolved", resolved), ("exit_status", quoted(exited)), ("messages", joined(F.concat(F.array(message("system", F.lit("s"))), "turns"))))
    )
    calls = turns(part(3), *tool_messages()).withColumn("record", fields(("task_id", named("k")), ("model", quoted(F.lit("cm"))), ("messages", joined(F.col("turns"))), ("info", info)))
    every = [x.select(F.col("u").alias("key"), "record") for x in (steps, texts, talks, calls)]
    return stored(every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]), "patch-records")


_BASE = f"""{E.values("cmds", "cmd, kind, pkind, path, fw", E.COMMANDS)},
{E.values("outs", "out, res, cnt, err, cls, obs, term", E.OUTPUTS)},
e0 as (select user_id as u, row_number() over (partition by user_id order by ts, event_id) - 1 as s, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events),
ev as (select u, s, k, c.* exclude (i), o.* exclude (i) from e0 join cmds c on c.i = k % {len(E.COMMANDS)} join outs o on o.i = (k // 5) % {len(E.OUTPUTS)}),
"""

_EVENT = """case when {kind} = 'test_run' then fw end as framework, case when {kind} = 'test_run' then res end as outcome, case when {kind} = 'test_run' then cnt end as tests_run"""


def _made(kind: str, users: str, pos: int = 1) -> str:
    """A row for each command, as SQL; kind: its kind there."""
    return f"""select u, s, {pos} as pos, {kind} as type, cmd as command, case when {kind} in ('file_read', 'file_edit') then path end as path,
      case when {kind} = 'file_edit' then 'modify' end as operation, {_EVENT.format(kind=kind)}, null as error_type, null as message, null::bigint as tokens_used from ev where {users}"""


def _errors(users: str, message: str = "out") -> str:
    return f"select u, s, 2, 'error_reveal', null, null, null, null, null, null, cls, left({message}, 300), null from ev where err and {users}"


def _numbered(rows: str, usage: str) -> str:
    return f"""made as ({rows}), nums as (select u as task_id, row_number() over (partition by u order by s, pos) - 1 as step, * exclude (u, s, pos) from made),
used as ({usage}),
every as (select * from nums union all select u, n.c, 'context_update', null, null, null, null, null, null, null, null, t from used join (select task_id, count(*) as c from nums group by 1) n on n.task_id = u)
select task_id, step, type, command, path, operation, framework, outcome, tests_run, error_type, md5(message) as message, tokens_used from every"""


_TB_KIND = "case when term is not null and kind in ('file_read', 'bash_call') then 'test_run' else kind end"
_SWE_KIND = "case when obs and pkind in ('file_read', 'bash_call') then 'test_run' else pkind end"
_TB = f"""{_made(_TB_KIND, "u % 2 = 0")}
  union all select u, s, 0, 'bash_call', 'echo start', null, null, null, null, null, null, null, null from ev where u % 2 = 0
  union all {_errors("u % 2 = 0", "case when k % 2 = 0 then chr(10) else '' end || out")}
  union all {_made("kind", "u % 2 = 1")} union all {_errors("u % 2 = 1")}"""
_SWE = f"""{_made(_SWE_KIND, "u % 4 < 3")} union all {_errors("u % 4 < 3")} union all {_made("kind", "u % 4 = 3")} union all {_errors("u % 4 = 3")}"""
_TB_USED = "select distinct u, u + 100 as t from ev where u % 2 = 1 and (u // 2) % 4 <> 2"
_SWE_USED = "select distinct u, u + 5 as t from ev where u % 4 in (0, 3)"


def _parsed(records: DataFrame, terminal: bool) -> DataFrame:
    out = R.events(R.heads(records, terminal))
    return out.select(
        "task_id", F.col("step").cast("bigint").alias("step"), "type", "command", "path", "operation", "framework", "outcome", "tests_run", "error_type", F.md5("message").alias("message"), "tokens_used"
    )


@query("parsed_terminal", f"with {_BASE} {_numbered(_TB, _TB_USED)}")
def parsed_terminal(spark, d):
    return _parsed(terminal_records(spark, d), True)


@query("parsed_patch", f"with {_BASE} {_numbered(_SWE, _SWE_USED)}")
def parsed_patch(spark, d):
    return _parsed(patch_records(spark, d), False)


_TB_HEADS = """select u as key, case when u % 2 = 0 then 'terminal' else 'chat' end as format,
    case when u % 2 = 1 then case when u % 3 = 0 then 'a' else 'b' end || u when u % 4 = 0 then 't' || u else 'r' || u end as name,
    case when u % 2 = 0 then 'm0' when (u // 2) % 4 = 1 then 'm1' else 'unknown' end as model, case when u % 2 = 0 then 'terminus' else 'inspect-ai' end as agent,
    case when u % 2 = 1 then case when (u // 2) % 5 in (0, 1, 4) then 'pass' else 'fail' end
      when u % 3 = 0 then 'pass' else coalesce(last_term, 'fail') end as outcome
  from (select u, arg_max(term, s) filter (where term is not null) as last_term, count(*) as n from ev group by u)"""
_SWE_HEADS = """select u as key, case u % 4 when 0 then 'steps' when 1 then 'role_text' when 2 then 'resolved' else 'chat' end as format,
    case when u % 4 = 3 then 'k' else 'i' end || u as name, case u % 4 when 0 then 'pm' when 1 then 'nm' when 2 then 'sm' else 'cm' end as model, 'swe-agent' as agent,
    case when u % 4 in (0, 3) then case when (u // 4) % 4 in (0, 2) then 'pass' else 'fail' end
      when u % 4 = 1 then case when (u // 4) % 2 = 0 then 'pass' else 'fail' end
      else case when (u // 4) % 4 in (0, 2) then 'pass' else 'fail' end end as outcome from (select distinct u from ev)"""


def _heads(records: DataFrame, terminal: bool) -> DataFrame:
    head = R.heads(records, terminal)
    return head.drop("record").join(R.outcomes(head).withColumnRenamed("task_id", "key"), "key")


@query("terminal_heads", f"with {_BASE} x as (select 1) {_TB_HEADS}")
def terminal_heads(spark, d):
    return _heads(terminal_records(spark, d), True)


@query("patch_heads", f"with {_BASE} x as (select 1) {_SWE_HEADS}")
def patch_heads(spark, d):
    return _heads(patch_records(spark, d), False)


@query("admission", f"""with {_BASE} made as ({_SWE}), used as ({_SWE_USED}), n as (select u, count(*) + max(case when u in (select u from used) then 1 else 0 end) as n from made group by u)
select case when n >= 70 then 'accepted' else 'filter_fail' end as reason, count(*) as records, cast(sum(case when n >= 70 then n else 0 end) as bigint) as events from n group by 1
union all select 'no_format', count(distinct user_id), 0 from events""")  # fmt: skip
def admission(spark, d):
    """Records with enough events are accepted; others, and as many without a format, are rejected with a reason."""
    good = patch_records(spark, d)
    bad = good.select((-F.col("key") - 1).alias("key"), F.lit('{"instance_id":"x"}').alias("record"))
    kept, events, lost = R.trajectories(good.unionByName(bad), terminal=False, least=70)
    told = kept.select("key", F.lit("accepted").alias("reason"), "n").unionByName(lost.select("key", "reason", F.lit(0).cast("bigint").alias("n")))
    return told.groupBy("reason").agg(F.count("*").alias("records"), F.sum("n").alias("events"))


@query("command_classes", f"with {_BASE} x as (select 1) select u, s, kind, pkind, path, fw from ev")
def command_classes(spark, d):
    c = F.col("cmd")
    return sampled(spark, d).select(
        "u", F.col("s").cast("bigint").alias("s"), X.classify_command(c).alias("kind"), X.classify_patch_command(c).alias("pkind"), X.file_path(c).alias("path"), X.framework(c).alias("fw")
    )


@query("output_classes", f"with {_BASE} x as (select 1) select u, s, res, cnt, err, cls, obs, term from ev")
def output_classes(spark, d):
    c = F.col("out")
    return sampled(spark, d).select(
        "u", F.col("s").cast("bigint").alias("s"), X.test_outcome(c).alias("res"), X.test_count(c).alias("cnt"), X.has_error(c).alias("err"), X.error_class(c).alias("cls"),
        (c.rlike(X.OBSERVED_PASS) | c.rlike(X.OBSERVED_FAIL)).alias("obs"), F.when(c.rlike(X.TERMINAL_PASS), "pass").when(c.rlike(X.TERMINAL_FAIL), "fail").alias("term"),
    )


# --- sessions ---------------------------------------------------------------------------------------------------------------

_TURN = f"""{E.values("us", "text, type, command, path, error, reason", E.USER_TURNS)}, {E.values("asst", "text, type, command, path, framework, outcome", E.ASSISTANT_TURNS)},
t0 as (select conv_id, turn, role, (conv_id * 3 + turn) as n, row_number() over (partition by conv_id order by turn) - 1 as i from conversations),
t as (select t0.*, case role when 'user' then u.text when 'assistant' then a.text else 'be brief' end as text, case role when 'user' then u.type when 'assistant' then a.type end as type,
    case role when 'user' then u.command when 'assistant' then a.command end as command,
    case when role = 'user' and u.type = 'file_read' then u.path when role = 'assistant' and a.type = 'file_edit' then a.path end as path, case when role = 'assistant' then a.framework end as framework,
    case when role = 'assistant' then a.outcome end as outcome, case when role = 'user' then u.error end as error_type, case when role = 'user' then u.reason end as reason,
    row_number() over (partition by conv_id, role in ('user', 'assistant') order by turn) - 1 as step
  from t0 join us u on u.i = n % {len(E.USER_TURNS)} join asst a on a.i = n % {len(E.ASSISTANT_TURNS)})"""


def sessions(spark, d) -> DataFrame:
    """(task_id, content): each conversation as a Markdown session of sample turns under changing headers."""
    df = table(spark, d, "conversations").withColumn("n", F.col("conv_id") * 3 + F.col("turn"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    head = F.when(user, choice(F.col("n") % 2, "User", "Human")).when(assistant, choice(F.col("n") % 4, "Assistant", "AI", "Copilot", "Agent")).otherwise("System")
    text = F.when(user, pick(E.USER_TURNS, 0, F.col("n"))).when(assistant, pick(E.ASSISTANT_TURNS, 0, F.col("n"))).otherwise("be brief")
    part = F.concat(F.lit("## "), head, F.lit(" \n\n"), text, F.lit("\n\n"))
    whole = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("x")))).alias("x"))
    return whole.select(F.col("conv_id").alias("task_id"), F.concat(F.lit("intro\n\n"), F.array_join(F.transform("x", lambda y: y["x"]), "")).alias("content"))


@query("markdown_turns", f"with {_TURN} select conv_id as task_id, i, case role when 'user' then case n % 2 when 0 then 'user' else 'human' end when 'assistant' then case n % 4 when 0 then 'assistant' when 1 then 'ai' when 2 then 'copilot' else 'agent' end else 'system' end as role, text from t")
def markdown_turns(spark, d):
    return P.markdown_turns(sessions(spark, d)).select("task_id", F.col("i").cast("bigint").alias("i"), "role", "text")


@query("session_events", f"with {_TURN} select conv_id as task_id, step, type, command, path, framework, outcome, error_type, reason from t where role <> 'system'")
def session_events(spark, d):
    out = P.session_events(P.markdown_turns(sessions(spark, d)))
    return out.select("task_id", F.col("step").cast("bigint").alias("step"), "type", "command", F.nullif("path", F.lit("")).alias("path"), "framework", "outcome", "error_type", "reason")


@query("session_results", f"with {_TURN} select conv_id as task_id, coalesce(arg_max(outcome, turn) filter (where type = 'test_run'), 'pass') as outcome, count(*) >= 5 as enough from t where role <> 'system' group by conv_id")
def session_results(spark, d):
    """The last test's outcome of each session, and whether it is long enough."""
    made = P.session_events(P.markdown_turns(sessions(spark, d)))
    ok = P.admitted(made, P.session_outcomes(made), least=5).select("task_id", F.lit(True).alias("enough"))
    return P.session_outcomes(made).join(ok, "task_id", "left").select("task_id", "outcome", F.coalesce("enough", F.lit(False)).alias("enough"))


# --- admission of texts -------------------------------------------------------------------------------------------------------


@query("secret_names", f"with {E.values('x', 'text, names', E.SECRETS)} select doc_id, names from documents join x on i = doc_id % {len(E.SECRETS)}")
def secret_names(spark, d):
    found = X.secrets(pick(E.SECRETS, 0, F.col("doc_id")))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("names"))


@query("licence_list", f"with {E.values('x', 'licence, ok', E.LICENCES)} select doc_id, licence, ok from documents join x on i = doc_id % {len(E.LICENCES)}")
def licence_list(spark, d):
    """Licences are looked up for each document's repository by a join with a small table, as a memo would."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % len(E.LICENCES)).cast("int").alias("repo"))
    memo = spark.createDataFrame([(i, r[0]) for i, r in enumerate(E.LICENCES)], "repo int, licence string")
    return R.with_licence(docs, memo).select("doc_id", "licence").withColumn("ok", X.licence_ok(F.col("licence")))


@query("licence_lookup", """select l.l_orderkey as order_id, l.l_linenumber as line, p.p_type as licence from lineitem l
    left join (select p_partkey, min(p_type) as p_type from part where p_size > 10 group by p_partkey) p on p.p_partkey = l.l_partkey""")
def licence_lookup(spark, d):
    """Every line item's part as its repository, looked up among the parts met before (those over size 10)."""
    known = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("repo"), F.col("p_type").alias("licence"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("repo"))
    return R.with_licence(lines, known).select("order_id", "line", "licence")


@query("vocabulary_leaks", f"with {E.values('x', 'text, terms', E.LEAKS)} select doc_id, terms from documents join x on i = doc_id % {len(E.LEAKS)}")
def vocabulary_leaks(spark, d):
    hits = X.leaked_terms(pick(E.LEAKS, 0, F.col("doc_id")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(hits), ",").alias("terms"))


@query("first_in_order", "select doc_id, lang from documents order by lang, doc_id limit 25")
def first_in_order(spark, d):
    """The first 25 in scan order (the limit is the operator)."""
    return R.first_n(table(spark, d, "documents").select("doc_id", "lang"), 25, "lang", "doc_id")
