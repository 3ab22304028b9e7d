"""Keyed sinks, missing inputs, tool messages by the call before them, medians, pairs by base, and what runs accept."""

import os
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from seqlens.functions.ordering import medians
from seqlens.operators import parse as P
from seqlens.operators import score as S
from seqlens.sources import files as X

CHAT = "task_id string, messages array<struct<role:string,content:string,tool_calls:array<struct<id:string,arguments:string>>,tool_call_id:string>>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chains_merge_by_id(spark, tmp_path):
    place = str(tmp_path / "chains")
    make = lambda ids, text: spark.createDataFrame([(f"c{i}" + ("_shuffled_1" if i % 3 == 0 else ""), "tb" if i % 2 else "swe", text) for i in ids], "chain_id string, source string, rendered string")
    X.write_chains(make(range(100), "old"), place)
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(place) for f in fs if f.endswith(".parquet")}
    X.write_chains(make([1, 4, 200], "new"), place)
    got = {r.chain_id: r.rendered for r in spark.read.parquet(place).collect()}
    assert len(got) == 101 and {k for k, v in got.items() if v == "new"} == {"c1", "c4", "c200"}
    after = {p for p in before if os.path.exists(p) and os.stat(p).st_mtime_ns == before[p]}
    assert len({os.path.dirname(p) for p in before} - {os.path.dirname(p) for p in after}) <= 3  # other partitions are untouched
    X.write_chains(make([1, 1, 1], "again"), place)
    assert spark.read.parquet(place).filter("chain_id = 'c1'").count() == 1


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        X.scan_records(spark, str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        X.scan_records(spark, str(tmp_path / "none"))
    with pytest.warns(UserWarning, match="missing"):
        records, rejected = X.read_trajectories(spark, str(tmp_path / "none.jsonl"))
    assert records.count() == rejected.count() == 0 and "task_id" in records.columns and "events" in records.columns


def loop_outcomes(messages):
    """(message, call) of each test with the last output between it and the next call of its id."""
    found = {}
    latest = {}
    for m, (role, calls, call_id, text) in enumerate(messages):
        for c, i in enumerate(calls):
            latest[i] = (m, c)
            found[m, c] = None
        if role == "tool" and call_id in latest:
            found[latest[call_id]] = text
    return found


def test_tool_messages_by_the_call_before_them(spark):
    rng = random.Random(8)
    for _ in range(3):
        messages = []
        for _ in range(60):
            if rng.random() < 0.5:
                messages.append(("assistant", [rng.choice("abc") for _ in range(rng.randint(0, 3))], None, None))
            else:
                messages.append(("tool", [], rng.choice("abcd"), rng.choice(["3 passed", "1 failed", "5 passed"])))
        rows = [(r, t, [(i, '{"cmd": "pytest -q"}') for i in cs], i) for r, cs, i, t in messages]
        df = P.chat_events(spark.createDataFrame([("t", rows)], CHAT))
        got = [(r.outcome, r.tests_run) for r in df.filter("type = 'test_run'").orderBy("step").collect()]
        want = [(None if t is None else "pass" if "passed" in t else "fail", None if t is None else int(t[0])) for _, t in sorted(loop_outcomes(messages).items())]
        assert got == want


def test_an_id_used_ten_thousand_times(spark):
    rows = spark.range(10_000).selectExpr("id", "id % 2 = 0 as call").selectExpr(
        "id", "struct(if(call, 'assistant', 'tool') as role, if(call, cast(null as string), concat(id, ' passed')) as content,"
        " if(call, array(struct('same' as id, '{\"cmd\": \"pytest\"}' as arguments)), array()) as tool_calls, if(call, cast(null as string), 'same') as tool_call_id) as msg",
    )
    records = rows.groupBy(F.lit("t").alias("task_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "msg"))), lambda x: x["msg"]).alias("messages"))
    df = P.chat_events(records)
    assert "Join" not in plan_of(df)
    began = time.time()
    got = [r.tests_run for r in df.orderBy("step").collect()]
    assert got == [2 * k + 1 for k in range(5000)] and time.time() - began < 60


def test_medians_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, 0.5, 1.0, 2.5, rng.random()])) for _ in range(501)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0)]
    got = {r.g: r.m for r in medians(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", F.col("v"), "m").collect()}
    want = {}
    for g, v in rows:
        if v is not None and g is not None:
            want.setdefault(g, []).append(v)
    assert got == {g: statistics.median(v) for g, v in want.items()}


def test_pairs_in_one_exchange(spark):
    rng = random.Random(4)
    rows = []
    for base in range(30):
        for seed in (1, 2):
            for variant in [None, *rng.sample([7, 8, 9], rng.randint(0, 3))]:
                for n in range(rng.choice([0, 1, 1, 2])):
                    rows.append((f"q{len(rows):05d}", f"c{base}" + (f"_shuffled_{variant}" if variant else ""), "m", seed, rng.randint(0, 1), n == 0, "t", "s", 0.0))
    schema = "query_id string, chain_id string, model string, seed int, l1 int, actionable boolean, gt_type string, source string, temperature double"
    df = spark.createDataFrame(rows, schema)
    last = {}
    for r in rows:
        last[r[1], r[3]] = r[4]
    want = set()
    real = {c for c, _ in last if "_shuffled_" not in c}
    for b in real:
        variants = {c for c, _ in last if c.startswith(f"{b}_shuffled_")}
        for seed in (1, 2):
            if not variants and (b, seed) in last:
                want.add((b, seed, None, last[b, seed], None, "real_only"))
            for v in variants:
                x, y = last.get((b, seed)), last.get((v, seed))
                if x is not None or y is not None:
                    want.add((b, seed, int(v.rsplit("_", 1)[1]), x, y, "both" if x is not None and y is not None else "real_only" if x is not None else "shuffled_only"))
    pairs = S.pairs(df)
    got = [(r.base_id, r.seed, r.shuffle_seed, r.real_l1, r.shuffled_l1, r.side) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(S.pairs(df))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_what_later_runs_accept(spark, tmp_path):
    place = str(tmp_path / "accepted")
    rows = [("aa", 1, 600), ("aa", 2, 900), ("ab", 3, 100), ("cc", 4, 700)]
    df = spark.createDataFrame(rows, "sha string, pos int, size int")
    take = lambda f: [(r.sha, r.pos) for r in P.accept_new(f, place, "sha", ["pos"], F.col("size") >= 500).orderBy("pos").collect()]
    assert take(df) == [("aa", 1), ("cc", 4)]
    assert take(df) == []  # the same files once more
    assert take(df.withColumn("size", F.lit(900))) == [("ab", 3)]  # what was rejected is judged again
    assert take(df.limit(0)) == []


def test_compression_logs(spark):
    from seqlens.operators import compress as C
    from tests.test_sequences import SCHEMA

    rows = [("file_read", "a", None), ("file_read", "b", None), ("file_read", "c", None), ("bash_call", None, "x"), ("bash_call", None, " x "), ("error_reveal", None, None), ("file_edit", "p", None), ("file_edit", "p", None)]
    rows = [(1, i, k, c, p, None, None, "m" * 121, None, None, None, None, None) for i, (k, p, c) in enumerate(rows)]
    rows += [(1, 8 + i, "task_transition", None, None, None, None, None, "why", None, None, None, None) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    log = lambda s: [r.line for r in C.compression_log(df, s).orderBy("step").collect()]
    assert log("swe") == ["[swe] step 0: read_burst", "[swe] step 4: retry", "[swe] step 5: short_message"]
    assert log("human") == ["[human] step 7: merged_edit", "[human] step 9: repeated_transition"]
    assert log("tb") == ["[tb] step 4: repeated_command"]
    with pytest.raises(ValueError, match="Unknown source"):
        C.compression_log(df, "other")
