"""Oracle SQL (DuckDB) as common table expressions that queries share."""

EV = """ev0 as (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
    row_number() over (partition by user_id order by ts, event_id) - 1 as step from events),
ev as (select user_id as task_id, step,
    case when event_type = 'signup' and k < 50 then 'file_edit' when event_type in ('signup', 'click') then 'bash_call'
      when event_type = 'view' then 'file_read' when event_type = 'error' then 'error_reveal' else 'test_run' end as type,
    case when event_type = 'click' then 'cmd_' || (k % 10) when event_type = 'signup' and k >= 50 then 'ls' end as command,
    case when event_type = 'view' or (event_type = 'signup' and k < 50) then 'p' || (k % 30) end as path,
    case when event_type = 'error' then 'E' || (k % 5) end as error_type,
    case when event_type = 'purchase' then case when value < 35 then 'fail' else 'pass' end end as outcome from ev0)"""

COMP = (
    EV
    + """,
n0 as (select *, coalesce(type = 'bash_call' and command = 'ls', false) as noop from ev),
n1 as (select *, lead(type) over w as nt, lead(noop) over w as nn from n0 window w as (partition by task_id order by step)),
c1 as (select * from n1 where not noop or coalesce(nt in ('file_read', 'file_edit', 'bash_call') and not nn, false)),
c2 as (select * from c1 window w as (partition by task_id order by step)
    qualify not coalesce(type = 'bash_call' and lag(type) over w = 'bash_call' and lag(command) over w = command, false)),
comp as materialized (select * from c2 window w as (partition by task_id order by step)
    qualify not coalesce(type = 'file_read' and lag(type) over w = 'file_read' and lag(path) over w = path, false))"""
)

LABELS = (
    COMP
    + """,
l0 as (select *, row_number() over (partition by task_id order by step) as seq,
    case when type in ('file_read', 'file_edit') then 'file' when type = 'error_reveal' then 'error' when type = 'bash_call' then 'command' end as lk,
    coalesce(path, error_type, command) as key from comp),
l1 as (select *, min(seq) over (partition by task_id, lk, key) as first from l0),
l2 as (select *, dense_rank() over (partition by task_id, lk order by first) - 1 as r from l1),
lab as materialized (select *, case when lk = 'file' and r < 26 then 'file_' || chr(cast(65 + r as int)) when lk = 'file' then 'file_OVERFLOW_' || (r - 25)
      when lk = 'error' then 'error_class_' || chr(cast(65 + least(r, 25) as int)) end as label,
    coalesce(last_value(case when lk = 'command' then 'command_' || (least(r, 25) + 1) end ignore nulls)
      over (partition by task_id order by seq rows between unbounded preceding and current row), 'command_1') as cmd_label,
    count(*) filter (where type = 'bash_call') over w as calls,
    count(*) filter (where type = 'test_run' and outcome <> 'pass') over w as fails,
    count(*) filter (where type = 'error_reveal') over w as errors
    from l2 window w as (partition by task_id order by seq rows between unbounded preceding and current row))"""
)

STATE = (
    LABELS
    + """,
st as (select task_id, seq, 'exploration' as left_phase, false as edited,
    case type when 'file_edit' then 'implementation' when 'test_run' then case outcome when 'pass' then 'validation' else 'debugging' end else 'exploration' end as phase,
    case type when 'file_read' then greatest(0::double, 0.5::double - 0.04::double) when 'error_reveal' then least(1::double, 0.5::double + 0.08::double) else 0.5::double end as u,
    type = 'file_edit' as edited_after
  from lab where seq = 1
  union all
  select l.task_id, l.seq, s.phase, s.edited_after,
    case l.type when 'file_edit' then case when not s.edited_after or s.phase not in ('implementation', 'debugging') then 'implementation' else s.phase end
      when 'test_run' then case l.outcome when 'pass' then 'validation' else 'debugging' end else s.phase end,
    case l.type when 'file_read' then greatest(0::double, s.u - 0.04::double) when 'error_reveal' then least(1::double, s.u + 0.08::double) else s.u end,
    s.edited_after or l.type = 'file_edit'
  from st s join lab l on l.task_id = s.task_id and l.seq = s.seq + 1)"""
)

#: Constraints: unc in thousandths, amount in thousandths.
CONS = (
    STATE
    + """,
j as materialized (select l.*, s.left_phase, s.edited, s.phase, s.u from lab l join st s using (task_id, seq)),
em as materialized (
  select task_id, seq, 0 as pos, step, 'ResourceBudget' as ctype, 'context_window' as resource, null::varchar as tool, null::varchar as state, null::int as recover_in,
    null::varchar as from_phase, null::varchar as to_phase, null::varchar as trig, null::varchar as added, null::varchar as dependency,
    null::varchar as objective, cast(round((1 - 150.0 * calls / 200000) * 1000) as bigint) as amount, null::bigint as unc, phase, cmd_label from j where type = 'bash_call'
  union all select task_id, seq, 0, step, 'InformationState', null, null, null, null, null, null, null, label, null, null, null,
    cast(round(u * 1000) as bigint), phase, cmd_label from j where type = 'file_read' or (type = 'error_reveal' and errors % 2 = 1)
  union all select task_id, seq, 0, step, 'CoordinationDependency', null, null, null, null, null, null, null, null, label, null, null, null, phase, cmd_label
    from j where type = 'error_reveal' and errors % 2 = 0
  union all select task_id, seq, 0, step, 'SubGoalTransition', null, null, null, null, left_phase, phase,
      case type when 'file_edit' then 'first_edit' else case outcome when 'pass' then 'test_pass' else 'test_fail' end end,
      null, null, null, null, null, phase, cmd_label
    from j where (type = 'file_edit' and (not edited or left_phase not in ('implementation', 'debugging')))
      or (type = 'test_run' and left_phase <> phase)
  union all select task_id, seq, 0, step, 'ToolAvailability', null, label, 'available', null, null, null, null, null, null, null, null, null, phase, cmd_label
    from j where type = 'file_edit' and edited and left_phase in ('implementation', 'debugging')
  union all select task_id, seq, 1, step, 'OptimizationCriterion', null, null, null, null, null, null, null, null, null, 'correctness_primary', null, null, phase, cmd_label
    from j where type = 'test_run' and outcome = 'pass'
  union all select task_id, seq, 1, step, 'ResourceBudget', 'patience_budget', null, null, null, null, null, null, null, null, null,
    greatest(0, 1000 - 150 * fails), null, phase, cmd_label from j where type = 'test_run' and outcome <> 'pass'
  union all select task_id, seq, 2, step, 'ToolAvailability', null, 'test_suite', 'unavailable', 3, null, null, null, null, null, null, null, null, phase, cmd_label
    from j where type = 'test_run' and outcome <> 'pass'),
cons as materialized (select *, row_number() over (partition by task_id order by seq, pos) - 1 as idx from em)"""
)

OBS = (
    CONS
    + """,
rev as (select task_id, added as entity, min(idx) as reveal from cons where added is not null group by all),
obs0 as (select c.* from cons c left join rev r on r.task_id = c.task_id and r.entity = c.tool and c.ctype = 'ToolAvailability'
    where reveal is null or idx >= reveal),
obs as materialized (select * exclude (idx), idx as orig_idx, row_number() over (partition by task_id order by idx) - 1 as idx from obs0)"""
)

VALID = (
    OBS
    + """,
cut as materialized (select * from obs where least(idx, 40) < 40),
adj as (select *, coalesce(step >= lag(step) over w, true) as ordered,
    coalesce((ctype, step, resource, tool, state, from_phase, to_phase, added, dependency, objective, amount, unc)
      is not distinct from lag((ctype, step, resource, tool, state, from_phase, to_phase, added, dependency, objective, amount, unc)) over w, false) as same
    from cut window w as (partition by task_id order by idx)),
chk as (select task_id, count(*) as n, count(*) filter (where ctype = 'SubGoalTransition') as subgoals,
    count(*) filter (where ctype = 'ToolAvailability' and state = 'unavailable') as unavailable,
    count(*) filter (where ctype = 'ResourceBudget') as budgets, bool_and(ordered) as ordered, bool_and(not same) as distinct_ from adj group by task_id),
val as materialized (select *, n between 20 and 40 and subgoals >= 2 and unavailable >= 1 and budgets >= 10 and ordered and distinct_ as valid from chk),
chain as materialized (select c.*, v.n from cut c join val v using (task_id) where valid)"""
)

ENTITY = "lower(coalesce(tool, added, to_phase, resource, dependency, objective))"

SIG = (
    VALID
    + f""",
sig0 as (select *, {ENTITY} as entity,
    coalesce(last_value(to_phase ignore nulls) over w, 'initial') as phase_now,
    coalesce(last_value(case when resource = 'context_window' and amount <> 1000 then amount end ignore nulls) over w, 1000) as ctx,
    coalesce(last_value(case when resource = 'patience_budget' and amount <> 1000 then amount end ignore nulls) over w, 1000) as pat,
    list(added) filter (where added is not null) over w as seen,
    list(dependency) filter (where dependency is not null) over w as deps,
    list(objective) filter (where objective is not null) over w as goals
    from chain window w as (partition by task_id order by idx rows between unbounded preceding and current row)),
sig as materialized (select *, case when ctx <= 0 then 0 when ctx < 250 then 1 when ctx < 500 then 2 when ctx < 750 then 3 else 4 end as cb,
    case when pat <= 0 then 0 when pat < 250 then 1 when pat < 500 then 2 when pat < 750 then 3 else 4 end as pb,
    list_sort(list_transform(list_distinct(coalesce(seen, [])), lambda x: x || '_revealed')) as status,
    list_sort(list_concat(list_transform(list_distinct(coalesce(deps, [])), lambda x: x || '_affected_module_M1'), list_distinct(coalesce(goals, [])))) as field,
    step // 10 as turn from sig0),
lev as materialized (select sig.*, level, phase_now || '|command_unknown|' || cb || '|' || pb
      || case when level < 3 then '|[' || array_to_string(status, ',') || ']' else '' end
      || case when level < 1 then '|[' || array_to_string(field, ',') || ']' else '' end
      || case when level < 2 then '|' || turn else '' end as key
    from sig, (values (0), (1), (2), (3)) v(level)),
dist as materialized (select level, key, entity, count(*) as cnt, min((task_id, idx)) as first_seen from lev where entity is not null group by all),
shr as (select *, cnt / sum(cnt) over (partition by level, key) as p,
    row_number() over (partition by level, key order by cnt desc, first_seen) as rank from dist)"""
)


def sql(prefix: str, tail: str) -> str:
    return f"with recursive {prefix}\n{tail}"
