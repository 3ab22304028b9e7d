"""Raw records of every format to trajectories, and the search source."""

import base64
import json
import sys
import types

from pyspark.sql import functions as F

from seqlens.operators import records as R
from seqlens.operators import score as J
from seqlens.plans import adapters


def frame(spark, recs):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "key int, record string")


def by_key(df, *cols):
    out = {}
    for r in df.orderBy("task_id", "step").collect():
        out.setdefault(r.task_id, []).append(tuple(r[c] for c in cols))
    return out


def test_patch_records(spark):
    recs = [
        {"instance_id": "a", "traj": [{"action": "ls", "observation": "x"}], "info": {"exit_status": "submitted", "model_stats": {"tokens_sent": 5, "tokens_received": 6}}},
        {"instance_id": "b", "target": True, "trajectory": [{"role": "system", "text": "s"}, {"role": "ai", "text": "```\nmake\n```"}, {"role": "user", "text": "done"}]},
        {"instance_id": "c", "resolved": False, "messages": [{"role": "assistant", "content": "cat x.py"}, {"role": "user", "content": "KeyError: k"}]},
        {"instance_id": "d"},
        {"id": "e", "trajectory": [{"action": "pytest", "observation": "1 passed"}], "info": {"model_patch": "diff"}},
    ]
    kept, events, lost = R.trajectories(frame(spark, recs), terminal=False, least=1)
    assert {(r.key, r.name, r.format, r.outcome) for r in kept.collect()} == {
        (0, "a", "steps", "pass"), (1, "b", "role_text", "pass"), (2, "c", "resolved", "fail"), (4, "e", "steps", "pass"),
    }
    assert by_key(events, "type", "command", "tokens_used") == {
        0: [("file_read", "ls", None), ("context_update", None, 11)],
        1: [("bash_call", "make", None)],
        2: [("file_read", "cat x.py", None), ("error_reveal", None, None)],
        4: [("test_run", "pytest", None)],
    }
    assert [(r.key, r.reason) for r in lost.collect()] == [(3, "no_format")]


def test_terminal_records(spark):
    call = {"id": "c", "function": {"name": "bash", "arguments": {"cmd": "pytest"}}}
    recs = [
        {"task": "t", "conversations": [{"role": "user", "content": "p"}, {"role": "assistant", "content": '{"commands": ["ls"]}'}]},
        {"id": 7, "output": {"model": "m"}, "scores": {"x": {"value": "C"}}, "messages": [{"role": "assistant", "tool_calls": [call]}, {"role": "tool", "content": "2 passed", "tool_call_id": "c"}]},
    ]
    kept, events, _ = R.trajectories(frame(spark, recs), terminal=True, least=1)
    assert {(r.key, r.name, r.model, r.outcome) for r in kept.collect()} == {(0, "t", "unknown", "fail"), (1, "7", "m", "pass")}
    assert by_key(events, "type", "command", "outcome") == {0: [("file_read", "ls", None)], 1: [("test_run", "pytest", "pass")]}


def test_usage(spark):
    recs = [{"metadata": {"usage": {}, "token_usage": {"input_tokens": 0, "total_tokens": 9}}}, {"stats": {"model_usage": {"prompt_tokens": 3}}}, {}]
    assert [r[0] for r in frame(spark, recs).orderBy("key").select(R.usage_tokens()).collect()] == [9, 3, 0]


def test_search_source(spark):
    from seqlens.sources.search import SearchReader, month_range

    assert month_range("2023-11", "2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    module = types.ModuleType("fake_client")
    module.find = lambda query, month, page: [("s", "r", "p", base64.b64encode(b"hi \xff").decode())] if page == 1 else []
    sys.modules["fake_client"] = module
    reader = SearchReader({"start": "2024-01", "end": "2024-02", "client": "fake_client:find"})
    assert [row for p in reader.partitions() for row in reader.read(p)] == [("s", "r", "p", "hi �", "2024-01"), ("s", "r", "p", "hi �", "2024-02")]


def test_limits_and_blinding(spark):
    df = spark.createDataFrame([("q1", "c", 1, "a"), ("q2", "c", 1, "b"), ("q3", "d", 2, "c")], "query_id string, chain_id string, cutoff_k int, response string")
    assert sorted(tuple(r) for r in J.blinded(df).collect()) == [("c", 1, "b"), ("d", 2, "c")]
    assert R.first_n(df, 2, "query_id").count() == 2
    R.gate(df.agg(F.count("*")), 3)
    assert adapters.table.__name__ == "table"
