"""Records of all formats are parsed once, and their events are numbered and classified once: plans stay small."""

import json

from pyspark.sql import functions as F

from seqlens.functions import text as X
from seqlens.operators import parse as P
from seqlens.operators import records as R
from seqlens.plans import record_queries as Q

TERMINAL = '{"trial_name":"r","conversations":[{"role":"user","content":"do"},{"role":"assistant","content":"{\\"commands\\":[{\\"keystrokes\\":\\"pytest\\"}]}"},{"role":"user","content":"KeyError: 3 passed"}]}'
CHAT = '{"sample_id":"b","metadata":{"usage":{"input_tokens":7}},"messages":[{"role":"assistant","tool_calls":[{"id":"c","function":{"arguments":"{\\"cmd\\":\\"pytest\\"}"}}]},{"role":"tool","tool_call_id":"c","content":"2 failed"}]}'
STEPS = '{"instance_id":"i","traj":[{"action":"edit 1:2","observation":"KeyError: x"},{"action":" ","observation":"OK"}],"info":{"model_stats":{"tokens_sent":3,"tokens_received":5}}}'
TEXTS = '{"instance_id":"j","trajectory":[{"role":"ai","text":"ls\\ncat a"},{"role":"ai","text":"make x"},{"role":"user","text":"1 passed"},{"role":"user","text":"and?"}]}'


def small(events) -> bool:
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    return "record" not in plan and len(plan) < 200_000 and plan.count("Window") < 20


def test_patch_records_are_parsed_once_too(spark):
    events = R.events(R.heads(spark.createDataFrame([(1, STEPS), (2, TEXTS)], "key long, record string"), False))
    got = [tuple(r) for r in events.select("task_id", "step", "type", "command", "outcome", "error_type", "tokens_used").orderBy("task_id", "step").collect()]
    assert got == [
        (1, 0, "file_edit", "edit 1:2", None, None, None),
        (1, 1, "error_reveal", None, None, "KeyError", None),
        (1, 2, "context_update", None, None, None, 8),
        (2, 0, "test_run", "make x", "pass", None, None),
    ]
    assert small(events)


def test_one_parse_and_small_plans(spark):
    head = R.heads(spark.createDataFrame([(1, TERMINAL), (2, CHAT), (3, "{}"), (4, '{"messages":{}}')], "key long, record string"), True)
    events = R.events(head)
    got = [tuple(r) for r in events.select("task_id", "step", "type", "outcome", "tests_run", "error_type", "tokens_used", "tokens_max").orderBy("task_id", "step").collect()]
    assert got == [
        (1, 0, "test_run", "pass", 3, None, None, None),
        (1, 1, "error_reveal", None, None, "KeyError", None, None),
        (2, 0, "test_run", "fail", 2, None, None, None),
        (2, 1, "error_reveal", None, None, "RuntimeError", None, None),
        (2, 2, "context_update", None, None, None, 7, 200_000),
    ]
    assert small(events)  # the JSON is not parsed again by whatever reads events


def test_admission_parses_turns_once(spark, monkeypatch):
    calls, turns = [], R.turns
    monkeypatch.setattr(R, "turns", lambda head: calls.append(1) or turns(head))
    records = spark.createDataFrame([(1, STEPS), (2, TEXTS), (-1, '{"instance_id":"x","info":{"model_stats":{"tokens_sent":9}}}')], "key long, record string")
    kept, events, lost = R.trajectories(records, terminal=False, least=3)
    assert [(r.key, r.n) for r in kept.collect()] == [(1, 3)] and events.count() == 3
    assert sorted((r.key, r.reason) for r in lost.collect()) == [(-1, "no_format"), (2, "filter_fail")]
    assert calls == [1]


def test_records_are_opened_in_one_pass(spark):
    odd = [
        '{"instance_id":"a","traj":[{"action":"ls","observation":"x"}],"info":{"x":"\\ud83d"}}',  # half a character: can't be written
        '{"instance_id":null,"messages":[{"role":"user","content":"x"}]}',
        '{"messages":[{"role":"user","content":"x"}]}',
        '{"instance_id":"d","messages":[{"role":"user","content":"x","tool_calls":[]}]}',
        '{"instance_id":"e","traj":[',
        None,
        '{"selected_models":["m"],"trajectory":[{"action":"x","text":"y"}]}',
    ]
    head = R.heads(spark.createDataFrame(list(enumerate(odd)), "key long, record string"), False)
    assert [tuple(r) for r in head.select("format", "name", "model").orderBy("key").collect()] == [
        ("steps", "a", "unknown"), ("resolved", "unknown", "unknown"), ("chat", "unknown", "unknown"), ("chat", "d", "unknown"),
        (None, "unknown", "unknown"), (None, "unknown", "unknown"), ("steps", "unknown", "m"),
    ]
    assert "json_tuple" in head._jdf.queryExecution().optimizedPlan().toString()


def test_a_parser_reads_turns_of_its_format(spark):
    turns = R.turns(R.heads(spark.createDataFrame([(1, STEPS), (2, TEXTS)], "key long, record string"), False))
    files = turns.filter("format = 'steps'").inputFiles()
    assert files and all("/format=steps/" in f for f in files)


def test_sample_records_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(Q, "stored", lambda df, name: df)
    plan = Q.patch_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 4


def test_cheaper_forms_give_the_same(spark):
    texts = ["", " ", "a", " a\n", "　b c ", "x\x1c", "OK", "1 passed", "Tests run: 2, Failures: 3", "TEST_A: FAIL", "ERRORS", "K", "oK", "```\n```", "```x", "`` ```sh\nls\n``` z"]
    c = F.col("c")
    df = spark.createDataFrame([(t,) for t in texts + [None]], "c string")
    fence = F.when(c.rlike(X.ACTION_FENCE), X.py_strip(F.regexp_extract(c, X.ACTION_FENCE, 1)))
    same = df.select(
        X.stripped(c).eqNullSafe(X.py_strip(c)).alias("s"), X.observed(c, X.folded(c)).eqNullSafe(c.rlike(X.OBSERVED_PASS) | c.rlike(X.OBSERVED_FAIL)).alias("o"), X.fenced_action(c).eqNullSafe(fence).alias("f")
    )
    assert [r for r in same.collect() if not (r.s and r.o and r.f)] == []
    args = ['{"command":"","input":"b"}', '{"cmd":null,"code":" c "}', "[1]", "ls ", "", None, '{"n":1,"x":{"y":"z"},"w":"v"}', '{"cmd":', "{}"]
    got = spark.createDataFrame(list(enumerate(args)), "i int, c string").orderBy("i").select(P.command_of_arguments(c), P.command_of_arguments(c, F.json_object_keys(c)))
    assert [tuple(r) for r in got.collect()] == [(x, x) for x in ("", "c", "[1]", "ls", "", "", "v", '{"cmd":', "")]


def test_admission_opens_records_once(spark, monkeypatch):
    calls, opened = [], R.opened
    monkeypatch.setattr(R, "opened", lambda records: calls.append(1) or opened(records))
    records = spark.createDataFrame([(1, STEPS), (2, TEXTS), (-1, '{"instance_id":"x"}')], "key long, record string")
    kept, _, lost = R.trajectories(records, terminal=False, least=3)
    assert [(r.key, r.outcome) for r in kept.collect()] == [(1, "fail")] and lost.count() == 2
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert calls == [1] and "json_tuple" not in plan


def test_admission_counts_acts_and_classifies_none(spark, monkeypatch):
    names, stored = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: names.append(name) or stored(df, name))
    records = spark.createDataFrame([(1, STEPS), (2, TEXTS), (3, CHAT), (-1, '{"instance_id":"x"}')], "key long, record string")
    kept, events, lost = R.trajectories(records, terminal=False, least=3)
    assert "events" not in names  # none are made to be counted
    n = {r.key: r.n for r in kept.collect()}
    assert n == {1: 3, 3: 3} == {r.task_id: r["count"] for r in events.groupBy("task_id").count().collect()}
    assert sorted(r.key for r in lost.collect()) == [-1, 2]
    for df in (kept, events, lost):  # admitted ids grow with the records
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in events.select("task_id", "step", "type", "outcome", "error_type", "tokens_used").orderBy("task_id", "step").collect()]
    assert got == [
        (1, 0, "file_edit", None, None, None), (1, 1, "error_reveal", None, "KeyError", None), (1, 2, "context_update", None, None, 8),
        (3, 0, "test_run", "fail", None, None), (3, 1, "error_reveal", None, "RuntimeError", None), (3, 2, "context_update", None, None, 7),
    ]


def test_counted_acts_try_only_what_makes_acts(spark):
    df = spark.createDataFrame([(1, 0, "ls", "3 passed", None), (1, 1, " ", "KeyError: x", None), (1, 2, "ls", "KeyError: x", None), (1, 3, None, None, 7)], "task_id long, i int, action string, observation string, tokens long")
    n = P.step_acts(df).groupBy("task_id").count()
    assert [tuple(r) for r in n.collect()] == [(1, 4)]
    assert "Failures" not in n._jdf.queryExecution().optimizedPlan().toString()  # the patterns of shown results


def test_sample_texts_are_made_once_and_dealt_by_number(spark, monkeypatch):
    c = F.col("c")
    texts = ["", "a}", 'x"}"', "}}", "\\", "\n\u3000{", "a"]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(Q.quoted(c).alias("q"), c)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("StructsToJson") == 1
    assert [json.loads(r.q) for r in got.collect()] == texts
    monkeypatch.setattr(Q, "stored", lambda df, name: df)
    plan = Q.patch_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 4


def test_actions_and_contents_are_worked_out_once(spark):
    texts = ["", " ", "a", "a\n b \r\n\x0b\n", "\u3000x\ry\x85 ", "\n\n", "a\x0bb", "```\n```", "``` ```z\nq```", "```x\n  ls \n```\nwell\n```\nno\n```", "```x", None]
    t = F.col("text")
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), X.py_strip), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    fence = F.when(t.rlike(X.ACTION_FENCE), X.py_strip(F.regexp_extract(t, X.ACTION_FENCE, 1)))
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(
        t, X.last_line(t).eqNullSafe(last).alias("l"), P.role_text_action().eqNullSafe(X.truthy(F.coalesce(fence, last))).alias("r"), P.chat_action().eqNullSafe(F.coalesce(fence, X.truthy(X.py_strip(t)))).alias("c")
    )
    assert [r for r in rows.collect() if not (r.l and r.r and r.c)] == []
    contents = [("[1", "[1"), (None, ""), ("x", "x"), ('["a",{"text":"b"},{"content":"c"},{"z":1},null," {\\"text\\":\\"d\\"}",[2]]', "a b c  d [2]"), ("[]", ""), ("", "")]
    got = spark.createDataFrame(contents, "text string, want string").select(X.flatten_content(t).alias("got"), "want")
    assert [r for r in got.collect() if r.got != r.want] == []
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
