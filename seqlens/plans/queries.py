"""Queries over the driver's tables, one for each operator or family, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chains as H
from ..operators import compress as C
from ..operators import parse as P
from ..operators import records
from ..operators import refdist as D
from ..operators import score as S
from ..operators import translate as T
from ..sources.distribution import DistributionTable
from ..storage import bucketed, drop_at_exit, shared_dir
from . import sql as Q
from .adapters import events, table

MODELS = ["model_a", "model_b"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _compressed(spark, d):
    return C.compress(events(spark, d), "tb")


def _rows(spark, d):
    return T.translate(_compressed(spark, d))


def _milli(c):
    return F.round(F.col(c) * 1000).cast("bigint").alias(c)


def _kept(spark, d):
    return H.truncate(H.observe(_rows(spark, d)))


def _chain_rows(spark, d):
    """Constraints of valid chains, named as chains."""
    return H.valid_rows(_kept(spark, d)).withColumn("chain_id", F.col("task_id").cast("string")).withColumn("source", F.lit("tb"))


def _chain_table(spark, d):
    """Constraints of valid chains, translated once and dealt by chain, for queries that read them several times."""
    return bucketed(_chain_rows(spark, d), "chains", ["chain_id"], ["chain_id", "idx"])


# --- compression ----------------------------------------------------------------------------------------------------------


@query("retry_compress", Q.sql(Q.EV, """select task_id, min(step) as step, any_value(command) as command, count(*) as tries from (
    select *, sum(cast(fresh as int)) over (partition by task_id order by step) as run from (
      select *, not coalesce(type = 'bash_call' and lag(type) over w = 'bash_call' and lag(command) over w = command, false) as fresh
      from ev window w as (partition by task_id order by step)))
    where type = 'bash_call' group by task_id, run"""))  # fmt: skip
def retry_compress(spark, d):
    df = C.retry_runs(events(spark, d)).filter("type = 'bash_call'")
    return df.select("task_id", F.col("step").cast("bigint").alias("step"), "command", F.coalesce("retry_count", F.lit(1)).cast("bigint").alias("tries"))


@query("terminal_dedup", Q.sql(Q.COMP, "select task_id, step, type, coalesce(command, path, error_type, outcome) as what from comp"))
def terminal_dedup(spark, d):
    what = F.coalesce("command", "path", "error_type", "outcome").alias("what")
    return _compressed(spark, d).select("task_id", F.col("step").cast("bigint").alias("step"), "type", what)


@query("read_bursts", Q.sql(Q.EV, """select task_id, min(step) as step, count(*) as burst_size, arg_min(path, step) as path,
    array_to_string(list(path order by step)[2:], ',') as others from (
      select *, row_number() over (partition by task_id order by step) - row_number() over (partition by task_id, type = 'file_read' order by step) as run from ev)
    where type = 'file_read' group by task_id, run having count(*) >= 3"""))  # fmt: skip
def read_bursts(spark, d):
    df = C.read_bursts(events(spark, d)).filter("burst_size is not null")
    return df.select("task_id", F.col("step").cast("bigint").alias("step"), F.col("burst_size").cast("bigint").alias("burst_size"), "path", F.array_join("additional_paths", ",").alias("others"))


@query("edit_merge", Q.sql(Q.EV, """select task_id, step, type, path from (select *, lag(type) over w as lt, lag(path) over w as lp from ev
    window w as (partition by task_id order by step)) where type = 'file_edit' and not coalesce(lt = 'file_edit' and lp = path, false)"""))  # fmt: skip
def edit_merge(spark, d):
    df = C.compress_human(events(spark, d)).filter("type = 'file_edit'")
    return df.select("task_id", F.col("step").cast("bigint").alias("step"), "type", "path")


@query("compression_log_counts", Q.sql(Q.COMP, """select reason, count(*) as n from (
    select case when noop and not coalesce(nt in ('file_read', 'file_edit', 'bash_call') and not nn, false) then 'no_op'
      when type = 'bash_call' then 'repeated_command' else 'repeated_read' end as reason
    from n1 where (task_id, step) not in (select (task_id, step) from comp)) group by reason"""))  # fmt: skip
def compression_log_counts(spark, d):
    return C.compression_log(events(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query("compression_log_sources", Q.sql(Q.EV, """select 'swe' as source, 'read_burst' as reason, count(*) as n from (select count(*) as n from (
      select *, row_number() over (partition by task_id order by step) - row_number() over (partition by task_id, type = 'file_read' order by step) as run from ev)
      where type = 'file_read' group by task_id, run having count(*) >= 3)
    union all select 'swe', 'retry', count(*) from (select type = 'bash_call' and lag(type) over w = 'bash_call' and lag(command) over w = command as same from ev
      window w as (partition by task_id order by step)) where same
    union all select 'human', 'merged_edit', count(*) from (select type = 'file_edit' and lag(type) over w = 'file_edit' and lag(path) over w = path as same from ev
      window w as (partition by task_id order by step)) where same"""))  # fmt: skip
def compression_log_sources(spark, d):
    """What the other two sources' compression logs."""
    out = [C.compression_log(events(spark, d), s).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), "reason", "n") for s in ("swe", "human")]
    return out[0].unionByName(out[1])


# --- translation ----------------------------------------------------------------------------------------------------------


@query("labels_first_seen", Q.sql(Q.LABELS, "select task_id, seq, type, label, cmd_label from lab"))
def labels_first_seen(spark, d):
    return T.folded(_compressed(spark, d)).select("task_id", F.col("seq").cast("bigint").alias("seq"), "type", "label", "cmd_label")


@query("budgets", Q.sql(Q.LABELS, """select task_id, seq, case when type = 'bash_call' then cast(round((1 - 150.0 * calls / 200000) * 1000) as bigint) end as amount,
    greatest(0, 1000 - 150 * fails) as patience, errors % 2 = 0 as odd_error from lab"""))  # fmt: skip
def budgets(spark, d):
    df = T.folded(_compressed(spark, d))
    return df.select("task_id", F.col("seq").cast("bigint").alias("seq"), _milli("amount"), _milli("patience"), "odd_error")


@query("context_exhausted_once", """with recursive e as (select user_id as task_id, row_number() over (partition by user_id order by ts, event_id) as seq,
      event_type = 'click' as c, event_type = 'purchase' as up, cast(regexp_extract(props, '[0-9]+', 0) as bigint) * 2000 as used from events),
    g as (select *, count(*) filter (where up) over (partition by task_id order by seq) as ep from e),
    h as (select *, coalesce(max(case when up then used end) over (partition by task_id, ep), 0)
      + 150 * count(*) filter (where c) over (partition by task_id, ep order by seq rows between unbounded preceding and current row) as now from g)
    select task_id, min(seq) as seq from h where (c or up) and round(1 - least(now, 200000) / 200000.0, 3) < 0.2 group by task_id""")  # fmt: skip
def context_exhausted_once(spark, d):
    df = table(spark, d, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.when(F.col("event_type") == "click", "bash_call").when(F.col("event_type") == "purchase", "context_update").otherwise("other")
    used = F.regexp_extract("props", "[0-9]+", 0).cast("bigint") * 2000
    df = df.select(F.col("user_id").alias("task_id"), "step", kind.alias("type"), F.lit("x").alias("command"), used.alias("tokens_used"))
    out = T.folded(df).filter("context_runs_out")
    return out.select("task_id", F.col("seq").cast("bigint").alias("seq"))


@query("translate_full", Q.sql(Q.CONS, """select task_id, idx, ctype as type, step as ts, coalesce(resource, tool, to_phase, added, dependency, objective) as what, from_phase, trig as trigger,
    state, amount, unc as uncertainty, phase, cmd_label from cons"""))  # fmt: skip
def translate_full(spark, d):
    what = F.coalesce("resource", "tool", "to_phase", F.try_element_at("observable_added", F.lit(1)), "dependency", "objective").alias("what")
    cols = ["task_id", F.col("idx").cast("bigint").alias("idx"), "type", F.col("timestamp").alias("ts"), what, "from_phase", "trigger", "state", _milli("amount"), _milli("uncertainty"), "phase", "cmd_label"]
    return _rows(spark, d).select(*cols)


# --- chains ---------------------------------------------------------------------------------------------------------------


@query("reveal_suppression", Q.sql(Q.OBS, "select task_id, idx, orig_idx, ctype as type from obs"))
def reveal_suppression(spark, d):
    return H.observe(_rows(spark, d)).select("task_id", F.col("idx").cast("bigint").alias("idx"), F.col("orig_idx").cast("bigint").alias("orig_idx"), "type")


@query("chain_validity", Q.sql(Q.VALID, "select task_id, n, subgoals, unavailable, budgets, ordered, distinct_ as \"distinct\", valid from val"))
def chain_validity(spark, d):
    return H.validity(_kept(spark, d))


@query("admission_reasons", Q.sql(Q.VALID, "select case when valid then 'accepted' else 'filter_fail' end as reason, count(*) as n from val group by 1"))
def admission_reasons(spark, d):
    _, reasons = H.build_chains(_rows(spark, d), "tb")
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


_GATES = {"trajectories": 100, "chains": 50, "real_events": 10**9}


@query("gates", Q.sql(Q.VALID, """select gate, got, least, got >= least as passed from (select count(*) as t, count(*) filter (where valid) as c, cast(coalesce(sum(n), 0) as bigint) as e from val)
    cross join lateral (values ('trajectories', t, 100), ('chains', c, 50), ('real_events', e, 1000000000)) x(gate, got, least)"""))  # fmt: skip
def gates(spark, d):
    """Whether trajectories, valid chains and constraints reach their targets."""
    counts = H.validity(_kept(spark, d)).agg(F.count("*").alias("trajectories"), F.count_if("valid").alias("chains"), F.sum("n").alias("real_events"))
    return records.gates(counts, _GATES)


_PERM = ", ".join(f"({n}, {s}, {H.permutation(n, s)})" for n in range(H.LEAST, H.MOST + 1) for s in H.SEEDS)


@query("permuted_chain", Q.sql(Q.VALID + f""", perm(n, seed, p) as (values {_PERM}),
    places as (select n, seed, unnest(p) as from_idx, generate_subscripts(p, 1) - 1 as idx from perm),
    times as (select task_id, step, row_number() over (partition by task_id order by step, idx) - 1 as idx from chain)""",
    """select 'tb_' || c.task_id || '_shuffled_' || q.seed as chain_id, q.idx, c.ctype as type, t.step as ts
    from chain c join places q on q.n = c.n and q.from_idx = c.idx join times t on t.task_id = c.task_id and t.idx = q.idx"""))  # fmt: skip
def permuted_chain(spark, d):
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    out = H.permute(chains).select("chain_id", F.posexplode("constraints").alias("idx", "c"))
    return out.select("chain_id", F.col("idx").cast("bigint").alias("idx"), "c.type", F.col("c.timestamp").alias("ts"))


@query("render_lines", Q.sql(Q.VALID, r"""select 'tb_' || task_id as chain_id, idx, 'Step ' || (idx + 1) || ' (step=' || step || '):' || chr(10) || '  ' ||
    case ctype when 'ResourceBudget' then 'ResourceBudget: ' || resource || ' at ' || printf('%d.%d', amount // 10, amount % 10) || '% (decay=' ||
        case resource when 'context_window' then 'monotone_decrease' else 'monotone_decrease_if_turn_based' end || ')'
      when 'ToolAvailability' then 'ToolAvailability: ' || tool || ' is now ' || upper(state) || case when state = 'unavailable' then ' (recover_in=' || recover_in || ')' else '' end
      when 'SubGoalTransition' then 'SubGoalTransition: phase shifted from ''' || from_phase || ''' to ''' || to_phase || ''' (trigger=' || trig || ')'
      when 'InformationState' then 'InformationState: added=[' || added || '] removed=[(empty)] uncertainty=' || printf('%d.%02d', unc // 1000, (unc % 1000) // 10)
      when 'CoordinationDependency' then 'CoordinationDependency: affected_module_M1 depends on ' || dependency || ' -> expected_action=resolve_' || dependency
      else 'OptimizationCriterion: objective=' || objective || ' weight_shift=correctness_increase' end as line from chain"""))  # fmt: skip
def render_lines(spark, d):
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    return chains.select("chain_id", F.posexplode(H.step_lines()).alias("idx", "line")).select("chain_id", F.col("idx").cast("bigint").alias("idx"), "line")


@query("prompt_cut", Q.sql(Q.VALID, "select 'tb_' || task_id as chain_id, greatest(1, n // 2) as cutoff_k, greatest(1, n // 2) as steps_shown from (select distinct task_id, n from chain)"))
def prompt_cut(spark, d):
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    shown = F.regexp_count("prompt", F.lit(r"Step \d+ \(")).cast("bigint")
    return chains.select("chain_id", F.col("cutoff_k").cast("bigint").alias("cutoff_k"), shown.alias("steps_shown"))


# --- documents ------------------------------------------------------------------------------------------------------------

VOCAB = ["test", "class", "import", "error", "password", "token", "license", "is", "the", "of", "Apache"]
_VOCAB = ", ".join(f"'{v}'" for v in VOCAB)


@query("leakage_hits", f"""select doc_id, array_to_string(list_filter([{_VOCAB}], lambda t: list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lower(t))), ',') as hits
    from documents""")  # fmt: skip
def leakage_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.leaked_terms(F.col("text"), VOCAB), ",").alias("hits"))


@query("secret_scan", """select doc_id, regexp_matches(text, 'AKIA[A-Z0-9]{16}') as aws,
    regexp_matches(text, '(?i)(?:password|passwd|secret|token)[ \\t\\n\\r]*[=:][ \\t\\n\\r]*["'']?[^ \\t\\n\\r"''<]{8,}') as credential from documents""")  # fmt: skip
def secret_scan(spark, d):
    found = X.secrets(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_contains(found, "aws_access_key").alias("aws"), F.array_contains(found, "credential_assignment").alias("credential"))


@query("email_redaction", r"select doc_id, md5(regexp_replace(text, '\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b', '<redacted-email>', 'g')) as digest from documents")
def email_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact_emails(F.col("text"))).alias("digest"))


@query("licence_mentions", "select doc_id, case when contains(text, 'Apache License') then 'Apache-2.0' when contains(text, 'MIT') then 'MIT' when contains(text, 'license') then 'other' end as licence,"
    " coalesce(case when contains(text, 'Apache License') then true when contains(text, 'MIT') then true when contains(text, 'license') then false end, true) as ok from documents")  # fmt: skip
def licence_mentions(spark, d):
    t = F.col("text")
    named = F.when(t.contains("Apache License"), "Apache-2.0").when(t.contains("MIT"), "MIT").when(t.contains("license"), "other")
    return table(spark, d, "documents").select("doc_id", named.alias("licence")).withColumn("ok", X.licence_ok(F.col("licence")))


@query("sha_dedup_first", "select min(doc_id) as doc_id, sha256(text) as sha from documents where length(text) >= 500 group by sha256(text)")
def sha_dedup_first(spark, d):
    df = table(spark, d, "documents").filter(F.char_length("text") >= 500).select("doc_id", F.sha2("text", 256).alias("sha"))
    return P.first_accepted(df, "sha", ["doc_id"]).select("doc_id", "sha")


@query("action_normalise", r"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text, ' ' || chr(10) || chr(9) || chr(13))), '\s+', ' ', 'g'), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g'), ' ')) as digest
    from documents""")  # fmt: skip
def action_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize_action(F.col("text"))).alias("digest"))


@query("line_classify", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    select kind, outcome, error_class, framework, count(*) as n from (select
      case when regexp_matches(line, '(?i)(pytest|npm\s+(run\s+)?test|make\s+test|go\s+test|cargo\s+test|yarn\s+test)') then 'test_run'
        when regexp_matches(line, '(?i)(>\s*\S+|\bsed\s+-i\b|\btee\s+\S|\btouch\s+\S|\bmv\s+\S|\bcp\s+\S|\brm\s+\S|\bpatch\s+|\bwrite_file\b|\bcreate_file\b)') then 'file_edit'
        when regexp_matches(line, '(?i)^\s*(cat|head|tail|less|more|grep|find|ls|tree|wc|file|stat|diff)\b') then 'file_read' else 'bash_call' end as kind,
      case when regexp_matches(line, '(?i)(\d+\s+failed|\bFAILED\b|\bERROR\b)') then 'fail' when regexp_matches(line, '(?i)(\d+\s+passed|\bOK\b|\ball\s+tests?\s+pass)') then 'pass' else 'fail' end as outcome,
      coalesce(nullif(regexp_extract(line, '\b(\w+(?:Error|Exception))\b', 1), ''), 'RuntimeError') as error_class,
      case when contains(lower(line), 'pytest') then 'pytest' when contains(lower(line), 'unittest') then 'unittest'
        when regexp_matches(lower(line), 'jest|npm|yarn') then 'jest' when contains(lower(line), 'go test') then 'go' when contains(lower(line), 'cargo test') then 'cargo'
        when contains(lower(line), 'rspec') then 'rspec' when regexp_matches(lower(line), 'mvn|gradle') then 'junit' else 'unknown' end as framework from l) group by all""")  # fmt: skip
def line_classify(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).withColumn("low", X.folded(F.col("line")))
    c, low = F.col("line"), F.col("low")
    df = lines.select(X.classify_command(c, low).alias("kind"), X.test_outcome(c, low).alias("outcome"), X.error_class(c).alias("error_class"), X.framework(c).alias("framework"))
    return df.groupBy("kind", "outcome", "error_class", "framework").agg(F.count("*").alias("n"))


# --- conversations --------------------------------------------------------------------------------------------------------


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("i"), "role", "text")


@query("turn_classify", r"""select conv_id as task_id, row_number() over (partition by conv_id order by turn) - 1 as step,
      case when role = 'user' then 'task_transition' else 'bash_call' end as type,
      case when role = 'user' then left(string_split(trim(text), chr(10))[1], 80) end as reason,
      case when role = 'assistant' then 'explain: ' || left(string_split(trim(text), chr(10))[1], 80) end as command
    from conversations where role in ('user', 'assistant') and trim(text) <> ''""")  # fmt: skip
def turn_classify(spark, d):
    out = P.session_events(_turns(spark, d))
    return out.select("task_id", F.col("step").cast("bigint").alias("step"), "type", "reason", "command")


@query("session_outcome", "select conv_id as task_id, 'pass' as outcome from conversations where role in ('user', 'assistant') and trim(text) <> '' group by conv_id")
def session_outcome(spark, d):
    return P.session_outcomes(P.session_events(_turns(spark, d)))


@query("pending_action_pairs", r"""with a as (select conv_id, turn, role, text, count(*) filter (where role = 'user')
        over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as g from conversations),
      b as (select *, last_value(case when role = 'assistant' then nullif(trim(list_last(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))), '') end ignore nulls)
        over (partition by conv_id, coalesce(g, 0) order by turn rows between unbounded preceding and current row) as action from a)
    select conv_id as task_id, turn as i, action, md5(text) as observation from b where role = 'user' and action is not null""")  # fmt: skip
def pending_action_pairs(spark, d):
    out = P.pending_actions(_turns(spark, d), "assistant", P.role_text_action())
    return out.select("task_id", "i", "action", F.md5("observation").alias("observation"))


# --- distribution ---------------------------------------------------------------------------------------------------------


@query("signature_state", Q.sql(Q.SIG, "select cast(task_id as varchar) as chain_id, idx, phase_now, cb as context_bracket, pb as patience_bracket, array_to_string(status, ',') as status, array_to_string(field, ',') as field, turn from sig"))
def signature_state(spark, d):
    df = D.signatures(_chain_rows(spark, d))
    return df.select("chain_id", F.col("idx").cast("bigint").alias("idx"), "phase_now", "context_bracket", "patience_bracket", F.array_join("status", ",").alias("status"), F.array_join("field", ",").alias("field"), "turn")


def _dist(spark, d):
    return D.build(_chain_rows(spark, d))


@query("refdist_counts", Q.sql(Q.SIG, "select level, key, entity, cnt from dist"))
def refdist_counts(spark, d):
    return _dist(spark, d).select("level", "key", "entity", "cnt")


@query("refdist_stats", Q.sql(Q.SIG, "select 'tb' as source, level, count(distinct key) as keys, cast(sum(cnt) as bigint) as observations from dist group by level"))
def refdist_stats(spark, d):
    return D.stats(_dist(spark, d))


@query("refdist_topk", Q.sql(Q.SIG.replace("min((task_id, idx))", "min((cast(task_id as varchar), idx))"), "select level, key, entity, rank, cast(round(p * 10000) as bigint) as p from shr where rank <= 3"))
def refdist_topk(spark, d):
    return D.top_k(_dist(spark, d)).select("level", "key", "entity", F.col("rank").cast("bigint").alias("rank"), F.round(F.col("p") * 10000).cast("bigint").alias("p"))


@query("backoff_lookup", Q.sql(Q.SIG + """, h as (select task_id % 2 <> 0 as half, * from lev),
    dd as (select half, level, key, count(*) as n from h where entity is not null group by all)""", """select cast(h.task_id as varchar) as chain_id, h.idx, coalesce(min(dd.level), 3) as level
    from h left join dd on dd.half <> h.half and dd.level = h.level and dd.key = h.key group by all"""))  # fmt: skip
def backoff_lookup(spark, d):
    """Every step of every chain is asked of the distribution of the other half (even trajectories of odd ones, odd of even)."""
    rows, odd = _chain_table(spark, d), F.pmod("task_id", F.lit(2))
    half = lambda h: rows.withColumn("source", F.concat_ws("/", "source", h.cast("string")))
    asked = D.signatures(half(1 - odd)).withColumn("query_id", F.struct("chain_id", "idx"))
    known = _distribution(spark)
    for h in (0, 1):
        known.append(D.build(half(odd).filter(odd == h)))
    return D.lookup(asked, known.current()).select("query_id.chain_id", F.col("query_id.idx").cast("bigint").alias("idx"), "level")


def _distribution(spark):
    place = shared_dir(spark, "distribution")
    drop_at_exit(spark, place)
    return DistributionTable(spark, place, int(spark.conf.get("spark.sql.shuffle.partitions")))


_THIRDS = " union all ".join(
    f"select {v} as version, level, count(distinct key) as keys, count(*) as observations from (select * from lev where task_id % 3 < {most} and entity is not null) group by level"
    for v, most in ((1, 1), (2, 2), (3, 2), (4, 3))
)


@query("distribution_versions", Q.sql(Q.SIG, _THIRDS))
def distribution_versions(spark, d):
    """Three batches appended to a table that is compacted after the second; keys and observations as of each version."""
    rows, table_ = _chain_table(spark, d), _distribution(spark)
    for third in range(3):
        table_.append(D.build(rows.filter(F.pmod("task_id", F.lit(3)) == third)))
        if third == 1:
            table_.compact()
    out = None
    for version in range(1, 5):
        one = D.stats(table_.current(version)).select(F.lit(version).alias("version"), "level", "keys", "observations")
        out = one if out is None else out.unionByName(one)
    return out


@query("coverage", Q.sql(Q.SIG, "select 'tb' as source, count(*) as steps, count(*) as covered from sig where entity is not null"))
def coverage(spark, d):
    rows = _chain_table(spark, d)
    return D.coverage(rows, D.build(rows))


@query("entropy_top3", Q.sql(Q.SIG, """select count(*) as keys, cast(round(avg(h) * 1000) as bigint) as mean_entropy, cast(round(avg(t) * 1000) as bigint) as mean_top3 from (
    select key, -sum(p * ln(p)) as h, sum(p) filter (where rank <= 3) as t from shr where level = 0 group by key)"""))  # fmt: skip
def entropy_top3(spark, d):
    from ..operators.strata import key_entropy

    df = key_entropy(_dist(spark, d).filter("level = 0"))
    return df.agg(F.count("*").alias("keys"), F.round(F.avg("entropy") * 1000).cast("bigint").alias("mean_entropy"), F.round(F.avg("top3") * 1000).cast("bigint").alias("mean_top3"))


# --- evaluation and scoring -----------------------------------------------------------------------------------------------


@query("evaluation_matrix", """with c as (select doc_id, row_number() over (order by doc_id) - 1 as n from documents),
    w(model, m, c, seed) as (values ('model_a', 0, 0, 42), ('model_a', 0, 1, 42), ('model_a', 0, 2, 1337), ('model_b', 1, 0, 42), ('model_b', 1, 1, 42), ('model_b', 1, 2, 1337))
    select doc_id as chain_id, model, seed, printf('req%07d', n * 6 + m * 3 + c) as custom_id, (n * 6 + m * 3 + c) // 10000 as chunk from c, w""")  # fmt: skip
def evaluation_matrix(spark, d):
    chains = table(spark, d, "documents").select(F.col("doc_id").alias("chain_id"))
    return S.evaluation_matrix(chains, MODELS).select("chain_id", "model", "seed", "custom_id", "chunk")


_RESP = Q.SIG + """, r0 as (select c.*, greatest(1, n // 2) as k, m.model, m.seed, m.t from (select * from sig) c,
    (values ('model_a', 42, '0.0'), ('model_a', 42, '0.7'), ('model_a', 1337, '0.7'), ('model_b', 42, '0.0'), ('model_b', 42, '0.7'), ('model_b', 1337, '0.7')) m(model, seed, t)),
resp as (select task_id, model, seed, t, k, 'use ' || coalesce(entity, 'nothing') as response from r0
    where idx = cast('0x' || substr(md5(task_id || ':' || model || ':' || seed), 1, 6) as bigint) % n),
truth as (select task_id, idx, ctype, entity from sig),
sc as (select r.*, t.ctype as gt_type, cast(contains(r.response, t.entity) as int) as l1, t.ctype in ('ToolAvailability', 'InformationState', 'SubGoalTransition') as actionable
    from resp r join truth t on t.task_id = r.task_id and t.idx = r.k)"""  # fmt: skip


def _scored(spark, d):
    rows = _chain_table(spark, d)
    return S.scored(S.synthetic_responses(rows, MODELS), rows)


@query("layer1", Q.sql(_RESP, "select cast(task_id as varchar) as chain_id, model, seed, t as temperature, gt_type, l1, actionable from sc"))
def layer1(spark, d):
    return _scored(spark, d).select("chain_id", "model", "seed", F.col("temperature").cast("string").alias("temperature"), "gt_type", "l1", "actionable")


@query("layer2_legality", Q.sql(_RESP + """, av as (select r.task_id, r.model, r.seed, r.t, r.response, lower(c.tool) as tool, arg_max(c.state, c.idx) as state
    from resp r join chain c on c.task_id = r.task_id and c.idx < r.k and c.tool is not null group by all)""",
    """select cast(r.task_id as varchar) as chain_id, r.model, r.seed, r.t as temperature,
      cast(case when bool_or(a.state = 'unavailable' and contains(r.response, a.tool)) then 0 else 1 end as bigint) as legality
    from resp r left join av a using (task_id, model, seed, t) group by all"""))  # fmt: skip
def layer2_legality(spark, d):
    return _scored(spark, d).select("chain_id", "model", "seed", F.col("temperature").cast("string").alias("temperature"), F.col("legality").cast("bigint").alias("legality"))


@query("layer2_optimality", Q.sql(_RESP + """, av as (select r.task_id, r.model, r.seed, r.t, lower(c.tool) as tool, arg_max(c.state, c.idx) as state
    from resp r join chain c on c.task_id = r.task_id and c.idx < r.k and c.tool is not null group by all),
  gone as (select task_id, model, seed, t, list(tool) as tools from av where state = 'unavailable' group by all),
  hit as (select r.*, coalesce(g.tools, []) as tools, d.entity, d.cnt from resp r
    join lev l on l.task_id = r.task_id and l.idx = r.k and l.level = 0 join dist d on d.level = 0 and d.key = l.key left join gone g on g.task_id = r.task_id and g.model = r.model and g.seed = r.seed and g.t = r.t),
  legal as (select *, len(list_filter(tools, lambda u: contains(entity, u))) = 0 as free from hit)""",
    """select task_id || ':' || model || ':' || seed || ':' || t as query_id, 0 as backoff,
      cast(round(10000 * coalesce(sum(cnt) filter (where free and contains(response, entity)) / sum(cnt) filter (where free), 0)) as bigint) as optimality,
      cast(round(10000 * case when len(list_filter(any_value(tools), lambda u: contains(any_value(response), u))) > 0 then 0
        else coalesce(sum(cnt) filter (where free and contains(response, entity)) / sum(cnt) filter (where free), 0) end) as bigint) as coupled
    from legal group by task_id, model, seed, t"""))  # fmt: skip
def layer2_optimality(spark, d):
    rows = _chain_table(spark, d)
    dist = bucketed(D.build(rows), "shares", ["source", "key"])  # read for each level
    out = S.scored(S.synthetic_responses(rows, MODELS), rows, dist)
    tenthousandths = lambda c: F.round(F.col(c) * 10000).cast("bigint").alias(c)
    return out.select("query_id", "backoff", tenthousandths("optimality"), tenthousandths("coupled"))


@query("chain_strata", Q.sql(Q.VALID, """select length_bucket, composition, archetype, count(*) as n from (select task_id,
      case when n <= 25 then 'short_20_25' when n <= 32 then 'medium_26_32' else 'long_33_40' end as length_bucket,
      case when r > s then 'resource_dominated' when s > r then 'subgoal_dominated' else 'balanced' end as composition,
      case when g >= 4 then 'aggressive' else 'stall' end as archetype from (select task_id, count(*) as n, count(*) filter (where ctype = 'ResourceBudget') as r,
      count(*) filter (where ctype = 'SubGoalTransition') as s, count(*) filter (where ctype = 'ToolAvailability' and state = 'unavailable' and recover_in is null) as g
      from chain group by task_id)) group by all"""))  # fmt: skip
def chain_strata(spark, d):
    return S.classify_chains(_chain_rows(spark, d)).groupBy("length_bucket", "composition", "archetype").agg(F.count("*").alias("n"))


@query("grouping_families", Q.sql(_RESP, """select model, coalesce(source, '--') as source, coalesce(config, '--') as config, 'real' as condition, count(l1) as n, cast(sum(l1) as bigint) as hits,
      count(*) filter (where actionable) as n_actionable, cast(coalesce(sum(l1) filter (where actionable), 0) as bigint) as hits_actionable
    from (select *, 'tb' as source, 'T' || t || '_seed' || seed as config from sc)
    group by grouping sets ((model), (model, source), (model, config), (model, source, config))"""))  # fmt: skip
def grouping_families(spark, d):
    return S.grouping_families(_scored(spark, d))


@query("gt_type_cells", Q.sql(_RESP, "select model, 'tb' as source, gt_type, 'real' as condition, count(*) as n, cast(sum(l1) as bigint) as hits from sc group by all"))
def gt_type_cells(spark, d):
    return S.by_type(_scored(spark, d))


# pairs: labelled documents stand for results; the chain id says which document, language the model

_LAB = """p as (select doc_id // 4 as base, doc_id % 4 as v, doc_id, quality, toxic from labels)"""


def _results(spark, d):
    """Every label as a result: each fourth id a real chain, the others its shuffles."""
    df = table(spark, d, "labels")
    base, v = F.floor(F.col("doc_id") / 4).cast("string"), F.col("doc_id") % 4
    cid = F.when(v == 0, F.concat(F.lit("c"), base)).otherwise(F.concat(F.lit("c"), base, F.lit("_shuffled_"), v.cast("string")))
    return df.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("query_id"), cid.alias("chain_id"), F.lit("m").alias("model"), F.lit(42).alias("seed"), F.lit("s").alias("source"),
        F.lit(0.0).alias("temperature"), F.col("quality").cast("int").alias("l1"), (F.col("toxic") == 0).alias("actionable"), F.lit("t").alias("gt_type"),
    )


@query("pair_align", f"""with {_LAB}, b as (select base, count(*) filter (where v = 0) as r, count(*) filter (where v > 0) as s from p group by base)
    select 'c' || a.base as base_id, cast(x.v as int) as shuffle_seed, a.quality as real_l1, x.quality as shuffled_l1,
      case when x.v is null then 'real_only' else 'both' end as side
    from (select * from p where v = 0) a left join (select * from p where v > 0) x using (base)""")  # fmt: skip
def pair_align(spark, d):
    return S.pairs(_results(spark, d)).select("base_id", "shuffle_seed", "real_l1", "shuffled_l1", "side")


@query("pair_exclusions", f"with {_LAB} select 'c' || base as base_id from p group by base having count(*) filter (where v = 0) > 0 and count(*) filter (where v > 0) = 0")
def pair_exclusions(spark, d):
    return S.unpaired_bases(_results(spark, d))


for _name, _where in (("all", "true"), ("real", "a.toxic = 0"), ("both", "a.toxic = 0 and x.toxic = 0")):
    ORACLES[f"mcnemar_cells_{_name}"] = f"""with {_LAB} select 'm' as model, 's' as source, count(*) filter (where a.quality = 1 and x.quality = 1) as n11,
      count(*) filter (where a.quality = 1 and x.quality = 0) as b, count(*) filter (where a.quality = 0 and x.quality = 1) as c,
      count(*) filter (where a.quality = 0 and x.quality = 0) as n00, count(*) as n_pairs
      from (select * from p where v = 0) a join (select * from p where v > 0) x using (base) where {_where}"""
    QUERIES[f"mcnemar_cells_{_name}"] = lambda spark, d, how=_name: S.paired_cells(S.pairs(_results(spark, d)), how)


@query("z_statistic", """select lang, cast(round(1000 * case when p * (1 - p) > 0 then (p1 - p2) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)) else 0 end) as bigint) as z from (
    select lang, n1, n2, h1 / n1 as p1, h2 / n2 as p2, (h1 + h2) / (n1 + n2) as p from (select lang, count(*) filter (where toxic = 0) as n1, count(*) filter (where toxic = 1) as n2,
      count(*) filter (where toxic = 0 and quality = 1) as h1, count(*) filter (where toxic = 1 and quality = 1) as h2 from labels join documents using (doc_id) group by lang)
    where n1 > 0 and n2 > 0)""")  # fmt: skip
def z_statistic(spark, d):
    from ..operators.strata import two_sample_z

    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    out = two_sample_z(df, "lang", F.col("quality") == 1, F.col("toxic") == 0)
    return out.select("lang", F.round(F.col("z") * 1000).cast("bigint").alias("z"))


@query("welch_statistic", """select lang, cast(round(1000 * (m1 - m2) / sqrt(v1 / n1 + v2 / n2)) as bigint) as t from (select lang, avg(n_chars) filter (where quality = 1) as m1, avg(n_chars) filter (where quality = 0) as m2,
      var_samp(n_chars) filter (where quality = 1) as v1, var_samp(n_chars) filter (where quality = 0) as v2, count(*) filter (where quality = 1) as n1, count(*) filter (where quality = 0) as n2
    from labels join documents using (doc_id) group by lang) where n1 > 1 and n2 > 1""")  # fmt: skip
def welch_statistic(spark, d):
    from ..operators.strata import welch_t

    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return welch_t(df, "lang", F.col("n_chars"), F.col("quality") == 1).select("lang", F.round(F.col("t") * 1000).cast("bigint").alias("t"))


@query("paired_t_statistic", """select c_nationkey as nation, cast(round(1000 * avg(x) / (stddev_samp(x) / sqrt(count(*)))) as bigint) as t, count(*) as n
    from (select c_nationkey, o_totalprice - 100 * c_acctbal as x from orders join customer on c_custkey = o_custkey) group by 1 having count(*) > 1""")  # fmt: skip
def paired_t_statistic(spark, d):
    from ..operators.strata import paired_t_stat

    df = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    out = paired_t_stat(df.withColumn("x", F.col("o_totalprice") - 100 * F.col("c_acctbal")), "c_nationkey", F.col("x"))
    return out.select(F.col("c_nationkey").alias("nation"), F.round(F.col("t") * 1000).cast("bigint").alias("t"), "n")


@query("mann_whitney", """with r as (select o_orderstatus = 'F' as a, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as rk from orders where o_orderstatus in ('F', 'O'))
    select count(*) filter (where a) as n1, count(*) filter (where not a) as n2, cast(round(2 * (sum(rk) filter (where a) - count(*) filter (where a) * (count(*) filter (where a) + 1) / 2.0)) as bigint) as u2 from r""")  # fmt: skip
def mann_whitney(spark, d):
    from ..operators.strata import rank_sums

    df = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    out = rank_sums(df, F.col("o_totalprice"), F.col("o_orderstatus") == "F")
    u = F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2
    return out.select("n1", "n2", F.round(2 * u).cast("bigint").alias("u2"))


@query("cutoff_histogram", Q.sql(Q.VALID, """select case when f >= 0.3 and f < 0.4 then '0.3-0.4' when f >= 0.4 and f < 0.5 then '0.4-0.5' when f >= 0.5 and f < 0.6 then '0.5-0.6'
      when f >= 0.6 and f < 0.7 then '0.6-0.7' end as bin, count(*) as n from (select distinct task_id, cast(n // 2 as double) / n as f from chain) group by 1"""))  # fmt: skip
def cutoff_histogram(spark, d):
    from ..operators.strata import cutoff_bins

    n = _chain_rows(spark, d).groupBy("task_id").agg(F.count("*").alias("n"))
    return n.select(cutoff_bins(F.expr("n div 2") / F.col("n")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("stratified_sample", """select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by lang, source order by md5(doc_id || ':42'), doc_id) as r from documents) where r <= 20""")
def stratified_sample(spark, d):
    from ..operators.strata import sample_by_digest

    return sample_by_digest(table(spark, d, "documents"), ["lang", "source"], "doc_id", 20, 42).select("doc_id", "lang", "source")


@query("months", """select strftime(m, '%Y-%m') as month from (select unnest(generate_series(date_trunc('month', min(o_orderdate))::timestamp, max(o_orderdate), interval 1 month)) as m from orders)""")
def months(spark, d):
    from ..sources.files import months_of

    return months_of(table(spark, d, "orders"), "o_orderdate")
