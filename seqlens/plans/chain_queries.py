"""Queries of compression by source, transitions and context updates, rendering, prompts, requests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chains as H
from ..operators import compress as C
from ..operators import refdist as D
from ..operators import score as S
from ..operators import translate as T
from . import sql as Q
from .adapters import events, table
from .queries import MODELS, _chain_rows, _rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


# --- compression of the other two sources -------------------------------------------------------------------------------------

LONG = "message " * 30


def talkative(spark, d) -> DataFrame:
    """Events whose errors have long messages."""
    return events(spark, d).withColumn("message", F.when(F.col("type") == "error_reveal", F.concat(F.lit(LONG), "error_type")))


def shifting(spark, d) -> DataFrame:
    """Sign-ups are transitions: reason, phases from and to by number, some of them no phases."""
    df = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    names = [*T.PHASES, "lunch"]
    phase = lambda c: F.element_at(F.array(*map(F.lit, names)), (c % len(names)).cast("int") + 1)
    kind = F.when(F.col("event_type") == "signup", "task_transition").when(F.col("event_type") == "view", "file_edit").when(F.col("event_type") == "purchase", "test_run").otherwise("other")
    move = F.col("event_type") == "signup"
    return df.select(
        F.col("user_id").alias("task_id"), step.cast("int").alias("step"), kind.alias("type"),
        F.when(kind == "file_edit", F.concat(F.lit("p"), (F.col("k") % 4).cast("string"))).alias("path"),
        F.when(kind == "test_run", F.when(F.col("k") % 2 == 0, "pass").otherwise("fail")).alias("outcome"),
        F.when(move, phase(F.col("k"))).alias("from_phase"), F.when(move, phase(F.floor(F.col("k") / 7))).alias("to_phase"),
        F.when(move & (F.col("k") % 3 > 0), F.repeat(F.concat(F.lit("why"), (F.col("k") % 3).cast("string"), F.lit(" ")), 15)).alias("reason"),
        F.when(move & (F.col("k") % 5 == 0), "asked").alias("trigger"),
    )


_MOVE = f"""m0 as (select user_id as task_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as step, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events),
mv as (select task_id, step, case event_type when 'signup' then 'task_transition' when 'view' then 'file_edit' when 'purchase' then 'test_run' else 'other' end as type,
    case when event_type = 'view' then 'p' || (k % 4) end as path, case when event_type = 'purchase' then case when k % 2 = 0 then 'pass' else 'fail' end end as outcome,
    case when event_type = 'signup' then {list(T.PHASES) + ['lunch']}[k % 7 + 1] end as f, case when event_type = 'signup' then {list(T.PHASES) + ['lunch']}[(k // 7) % 7 + 1] end as t,
    case when event_type = 'signup' and k % 3 > 0 then repeat('why' || (k % 3) || ' ', 15) end as reason, case when event_type = 'signup' and k % 5 = 0 then 'asked' end as trig from m0)"""


@query("compress_patch", Q.sql(Q.EV + """,
  b as (select *, row_number() over (partition by task_id order by step) - row_number() over (partition by task_id, type = 'file_read' order by step) as run from ev),
  sized as (select *, count(*) over (partition by task_id, type = 'file_read', run) as size, row_number() over (partition by task_id, type = 'file_read', run order by step) as place from b),
  bursts as (select task_id, step, type, case when type = 'file_read' and size >= 3 then 'read_burst' else command end as command, path, error_type,
      case when type = 'file_read' and size >= 3 then size end as burst_size from sized where not (type = 'file_read' and size >= 3 and place > 1)),
  r0 as (select *, cast(not coalesce(type = 'bash_call' and lag(type) over w = 'bash_call' and lag(command) over w = command, false) as int) as fresh from bursts window w as (partition by task_id order by step)),
  r1 as (select *, sum(fresh) over (partition by task_id order by step) as grp from r0),
  r2 as (select *, count(*) over (partition by task_id, grp) as tries from r1)""", f"""select task_id, step, type, command, path, burst_size, case when tries > 1 then tries end as retry_count, length(case when type = 'error_reveal' then left('{LONG}' || error_type, 120) end) as message_length
  from r2 where fresh = 1"""))  # fmt: skip
def compress_patch(spark, d):
    out = C.compress(talkative(spark, d), "swe")
    return out.select(
        "task_id", F.col("step").cast("bigint").alias("step"), "type", "command", "path", F.col("burst_size").cast("bigint").alias("burst_size"),
        F.col("retry_count").cast("bigint").alias("retry_count"), F.char_length("message").cast("bigint").alias("message_length"),
    )


@query("compress_human", f"""with {_MOVE}, a as (select *, lag(type) over w as lt, lag(coalesce(reason, '')) over w as lr from mv window w as (partition by task_id order by step)),
  b as (select * from a where not coalesce(type = 'task_transition' and lt = 'task_transition' and lr = coalesce(reason, ''), false)),
  c as (select *, lag(type) over w as lt2, lag(path) over w as lp from b window w as (partition by task_id order by step))
  select task_id, step, type, reason, path from c where not coalesce(type = 'file_edit' and lt2 = 'file_edit' and lp = path, false)""")  # fmt: skip
def compress_human(spark, d):
    return C.compress(shifting(spark, d), "human").select("task_id", F.col("step").cast("bigint").alias("step"), "type", "reason", "path")


# --- translation --------------------------------------------------------------------------------------------------------------


@query("phase_transitions", f"""with recursive {_MOVE}, n as (select *, row_number() over (partition by task_id order by step) as seq from mv),
  st(task_id, seq, a, z, edited, made) as (select task_id, 0::bigint, 'exploration', 'exploration', false, false from (select distinct task_id from n)
  union all select n.task_id, n.seq,
    case when n.type = 'task_transition' then case when g.src = g.dst then s.z else g.src end else s.z end,
    case n.type when 'file_edit' then case when not s.edited or s.z not in ('implementation', 'debugging') then 'implementation' else s.z end
      when 'test_run' then case n.outcome when 'pass' then 'validation' else 'debugging' end
      when 'task_transition' then case when g.src = g.dst then case when s.z = 'exploration' then 'hypothesis' else 'exploration' end else g.dst end else s.z end,
    s.edited or n.type = 'file_edit',
    case n.type when 'task_transition' then true when 'file_edit' then not s.edited or s.z not in ('implementation', 'debugging')
      when 'test_run' then s.z <> case n.outcome when 'pass' then 'validation' else 'debugging' end else false end
    from st s join n on n.task_id = s.task_id and n.seq = s.seq + 1
    cross join lateral (select case when list_contains({list(T.PHASES)}, n.f) then n.f else s.z end as src, case when list_contains({list(T.PHASES)}, n.t) then n.t else 'exploration' end as dst) g)
  select st.task_id, n.step as ts, a as from_phase, z as to_phase,
    case n.type when 'file_edit' then 'first_edit' when 'test_run' then 'test_' || n.outcome else left(coalesce(n.reason, n.trig, 'task_transition'), 50) end as trigger
  from st join n using (task_id, seq) where made""")  # fmt: skip
def phase_transitions(spark, d):
    out = T.translate(shifting(spark, d)).filter("type = 'SubGoalTransition'")
    return out.select("task_id", F.col("timestamp").alias("ts"), "from_phase", "to_phase", "trigger")


_CTX = """e as (select user_id as task_id, row_number() over (partition by user_id order by ts, event_id) as seq,
    event_type = 'click' as c, event_type = 'purchase' as up, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k from events),
  g as (select *, count(*) filter (where up) over (partition by task_id order by seq) as ep from e),
  h as (select *, coalesce(max(case when up then case when k % 10 = 0 then 0 else k * 2000 + 7 end end) over (partition by task_id, ep), 0) as used,
    coalesce(max(case when up then case when k % 7 = 0 then 200000 else 90007 end end) over (partition by task_id, ep), 200000) as most,
    count(*) filter (where c) over (partition by task_id, ep order by seq rows between unbounded preceding and current row) as calls from g),
  a as (select *, greatest(0, 1 - (case when calls > 0 then least(used + 150 * calls, most) else used end) / most) as left_ from h where c or up)"""


@query("context_updates", f"with {_CTX} select task_id, seq - 1 as ts, cast(round(left_ * 1000) as bigint) as amount from a")
def context_updates(spark, d):
    """Budgets after commands, and after updates that set what is used (0 or null: nothing) and at most (0 or null: the usual)."""
    df = table(spark, d, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    kind = F.when(F.col("event_type") == "click", "bash_call").when(F.col("event_type") == "purchase", "context_update").otherwise("other")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    used = F.when(k % 10 > 0, k * 2000 + 7)
    most = F.when(k % 7 == 0, F.lit(0)).otherwise(90_007)
    df = df.select(F.col("user_id").alias("task_id"), "step", kind.alias("type"), F.lit("x").alias("command"), used.alias("tokens_used"), most.cast("bigint").alias("tokens_max"))
    out = T.translate(df).filter("resource = 'context_window'")
    return out.select("task_id", F.col("timestamp").alias("ts"), F.round(F.col("amount") * 1000).cast("bigint").alias("amount"))


# --- chains -------------------------------------------------------------------------------------------------------------------


@query("resource_buckets", Q.sql(Q.VALID, """select bucket, count(*) as n from (select case when amount <= 0 then 0 when amount <= 250 then 250 when amount <= 500 then 500 when amount <= 750 then 750 else 1000 end as bucket
    from chain where ctype = 'ResourceBudget') group by 1"""))  # fmt: skip
def resource_buckets(spark, d):
    rows = _chain_rows(spark, d).filter("type = 'ResourceBudget'")
    return rows.groupBy((H.resource_bucket(F.col("amount")) * 1000).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


_PERM = ", ".join(f"({n}, {s}, {H.permutation(n, s)})" for n in range(H.LEAST, H.MOST + 1) for s in H.SEEDS)


@query("permuted_pairs", Q.sql(Q.VALID + f""", perm(n, seed, p) as (values {_PERM}), places as (select n, seed, unnest(p) as from_idx, generate_subscripts(p, 1) - 1 as idx from perm)""",
    """select 'tb_' || c.task_id || '_shuffled_' || q.seed as chain_id, 'tb_' || c.task_id as match_id, greatest(1, c.n // 2) as cutoff_k, q.idx, c.phase, c.cmd_label
    from chain c join places q on q.n = c.n and q.from_idx = c.idx"""))  # fmt: skip
def permuted_pairs(spark, d):
    """Pairs are permuted like constraints; what was said of the real chain (match_id, cutoff_k) goes along."""
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    out = H.permute(chains).select("chain_id", "match_id", "cutoff_k", F.posexplode("active_pairs").alias("idx", "p"))
    return out.select("chain_id", "match_id", F.col("cutoff_k").cast("bigint").alias("cutoff_k"), F.col("idx").cast("bigint").alias("idx"), F.col("p")[0].alias("phase"), F.col("p")[1].alias("cmd_label"))


_LINE = r"""'Step ' || (idx + 1) || ' (step=' || step || '):' || chr(10) || '  ' ||
    case ctype when 'ResourceBudget' then 'ResourceBudget: ' || resource || ' at ' || printf('%d.%d', amount // 10, amount % 10) || '% (decay=' ||
        case resource when 'context_window' then 'monotone_decrease' else 'monotone_decrease_if_turn_based' end || ')'
      when 'ToolAvailability' then 'ToolAvailability: ' || tool || ' is now ' || upper(state) || case when state = 'unavailable' then ' (recover_in=' || recover_in || ')' else '' end
      when 'SubGoalTransition' then 'SubGoalTransition: phase shifted from ''' || from_phase || ''' to ''' || to_phase || ''' (trigger=' || trig || ')'
      when 'InformationState' then 'InformationState: added=[' || added || '] removed=[(empty)] uncertainty=' || printf('%d.%02d', unc // 1000, (unc % 1000) // 10)
      when 'CoordinationDependency' then 'CoordinationDependency: affected_module_M1 depends on ' || dependency || ' -> expected_action=resolve_' || dependency
      else 'OptimizationCriterion: objective=' || objective || ' weight_shift=correctness_increase' end"""
_DRAWN = Q.VALID + f", lines as (select task_id, idx, n, {_LINE} as line from chain), texts as (select task_id, any_value(n) as n, list(line order by idx) as ls from lines group by task_id)"
_ASK = "chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Given the state above, propose the next action for your pipeline at' || chr(10) || 'step ' || (greatest(1, n // 2) + 1) || '. Output only the action label (e.g., \"use command_2\" or \"switch to file_C\"). No explanation.'"


@query("rendered_chain", Q.sql(_DRAWN, f"""select 'tb_' || task_id as chain_id, md5('# Constraint chain (perspective=tb)' || chr(10) || array_to_string(ls, chr(10)) || chr(10)) as rendered,
    md5(array_to_string(ls[1:greatest(1, n // 2)], chr(10)) || {_ASK}) as prompt, 0 as leaks from texts"""))  # fmt: skip
def rendered_chain(spark, d):
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    return chains.select("chain_id", F.md5("rendered").alias("rendered"), F.md5("prompt").alias("prompt"), F.size(H.leaked_terms(F.col("rendered"))).alias("leaks"))


@query("prefix_cuts", Q.sql(_DRAWN, "select 'tb_' || task_id as chain_id, k, md5(case when k > 0 then array_to_string(ls[1:k], chr(10)) else '' end) as shown from texts, (values (-1), (0), (1), (7), (99)) v(k)"))
def prefix_cuts(spark, d):
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    df = chains.withColumn("k", F.explode(F.array(*map(F.lit, (-1, 0, 1, 7, 99)))))
    return df.select("chain_id", "k", F.md5(H.first_steps(F.col("k"))).alias("shown"))


@query("leaking_permutations", Q.sql(Q.VALID, """select 'tb_' || task_id || '_shuffled_' || seed as chain_id from (select task_id from chain group by task_id having count(*) filter (where 'file_C' in (added, tool, dependency)) = 0), (values (42), (1337), (7919)) s(seed)"""))
def leaking_permutations(spark, d):
    """Permutations whose text leaks are left out alone, their chains stay: here "file_C" leaks."""
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    return H.shuffled(chains, "tb", ["file_C"]).select("chain_id")


@query("distribution_update", Q.sql(Q.SIG, "select level, key, entity, cnt, cast(first_seen[1] as varchar) as first_chain from (select level, key, entity, count(*) as cnt, min((cast(task_id as varchar), idx)) as first_seen from lev where entity is not null group by all)"))
def distribution_update(spark, d):
    """A distribution of the even trajectories to which the observations of the odd ones are added: that of all."""
    rows = _chain_rows(spark, d)
    odd = F.pmod("task_id", F.lit(2)) == 1
    both = D.add_observations(D.build(rows.filter(~odd)), D.build(rows.filter(odd)))
    return both.select("level", "key", "entity", "cnt", F.col("first_seen.chain_id").alias("first_chain"))


# --- requests -----------------------------------------------------------------------------------------------------------------

_MATRIX = """w(model, m, c, t, seed) as (values ('model_a', 0, 0, '0.0', 42), ('model_a', 0, 1, '0.7', 42), ('model_a', 0, 2, '0.7', 1337), ('model_b', 1, 0, '0.0', 42), ('model_b', 1, 1, '0.7', 42), ('model_b', 1, 2, '0.7', 1337)),
  ids as (select doc_id, row_number() over (order by doc_id) - 1 as n from documents), req as (select *, n * 6 + m * 3 + c as number from ids, w)"""


@query("request_routing", f"""with {_MATRIX} select model, seed, t as temperature, count(*) filter (where number % 7 > 0) as succeeded, count(*) filter (where number % 7 = 0) as errored from req group by all""")
def request_routing(spark, d):
    """Results find their requests by id; here every seventh request has failed."""
    made = S.evaluation_matrix(table(spark, d, "documents").select(F.col("doc_id").alias("chain_id")), MODELS)
    number = F.substring("custom_id", 4, 20).cast("bigint")
    results = made.select("custom_id", F.when(number % 7 > 0, F.concat(F.lit("use "), "custom_id")).alias("response"))
    routed = S.route(made, results)
    return routed.groupBy("model", "seed", F.col("temperature").cast("string").alias("temperature")).agg(
        F.count_if(F.col("response").isNotNull()).alias("succeeded"), F.count_if(F.col("response").isNull()).alias("errored")
    )


@query("request_bodies", Q.sql(_DRAWN, f"""select 'tb_' || task_id as chain_id, model, t as temperature, 'v2.0-code' as prompt_version, {len(H.SYSTEM_PROMPT)} as system_length, md5(array_to_string(ls[1:greatest(1, n // 2)], chr(10)) || {_ASK}) as prompt
    from texts, (values ('model_a', '0.0'), ('model_a', '0.7'), ('model_a', '0.7'), ('model_b', '0.0'), ('model_b', '0.7'), ('model_b', '0.7')) w(model, t)"""))  # fmt: skip
def request_bodies(spark, d):
    """What a dry run would send: prompts with the system prompt and its version."""
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    sent = S.requests(chains, MODELS)
    return sent.select(
        "chain_id", "model", F.col("temperature").cast("string").alias("temperature"), "prompt_version", F.char_length("system").alias("system_length"), F.md5("prompt").alias("prompt")
    )


@query("legacy_ids", """select doc_id, lang || '||' || (doc_id % 9) || '||' || source || '||' || doc_id as custom_id, lang as model, cast(doc_id % 9 as int) as seed, source || '||' || doc_id as chain_id from documents""")
def legacy_ids(spark, d):
    made = table(spark, d, "documents").select("doc_id", S.legacy_id(F.col("lang"), F.col("doc_id") % 9, F.concat_ws("||", "source", "doc_id")).alias("custom_id"))
    return made.select("*", S.from_legacy_id(F.col("custom_id")).alias("x")).select("doc_id", "custom_id", "x.*")


@query("runs_by_source", Q.sql(Q.VALID, """select source, condition, count(*) as requests from (select distinct task_id from chain), (values ('tb'), ('swe')) s(source), (values ('real', 1), ('shuffled', 3)) v(condition, times), range(times * 6) group by all"""))
def runs_by_source(spark, d):
    """Every source and condition in turn; those without chains would be left out."""
    rows, out = _rows(spark, d), None
    for source in ("tb", "swe", "human"):
        real, _ = H.build_chains(rows if source != "human" else rows.filter("false"), source)
        for condition, chains in (("real", real), ("shuffled", H.permute(real))):
            part = S.requests(chains, MODELS).groupBy(F.lit(source).alias("source"), F.lit(condition).alias("condition")).agg(F.count("*").alias("requests"))
            out = part if out is None else out.unionByName(part)
    return out
