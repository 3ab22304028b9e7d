"""Translation in parts: any cut of a trajectory gives what the whole gives."""

import random

import pytest

from seqlens.operators import fold
from seqlens.operators import translate as T
from tests.test_sequences import SCHEMA, loop_translate, made


def read(event):
    """An event as the fold reads it."""
    kind = event["type"]
    name = None
    if kind in fold.FILES:
        name = event.get("path") or None
    elif kind == "error_reveal":
        name = event.get("error_type") or "RuntimeError"
    elif kind == "bash_call":
        name = ((event.get("command") or "").split() or ["unknown"])[0]
    outcome = "pass" if event.get("outcome") == "pass" else "fail"
    return kind, outcome, event.get("from_phase"), event.get("to_phase"), name, event.get("tokens_used"), event.get("tokens_max")


def restarted(state, part):
    """The state as it reaches a part: through Arrow, with the names the part uses alone."""
    import pyarrow as pa

    columns = {"task_id": [1, 1], "part": [0, 1], "first_step": [0, 60]}
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})
    summaries = [fold.summary(iter(state)), fold.summary(iter(part))]
    for name, kind in fold._columns(fold.SUMMARY_FIELDS):
        table = table.append_column(name, pa.array([getattr(s, name) for s in summaries], kind))
    return fold.starts(table)


@pytest.mark.parametrize("seed", range(6))
def test_every_cut(seed):
    events = [read(e) for e in made(1, 150, seed)]
    whole = list(fold.walk(fold.State(), iter(events)))
    for cut in range(1, len(events)):
        state = fold.State().after(fold.summary(iter(events[:cut])))
        assert list(fold.walk(state, iter(events[cut:]))) == whole[cut:], cut


def test_three_parts_compose():
    events = [read(e) for e in made(1, 200, 11)]
    whole = list(fold.walk(fold.State(), iter(events)))
    rng = random.Random(1)
    for _ in range(100):
        a, b = sorted(rng.sample(range(1, 200), 2))
        state = fold.State().after(fold.summary(iter(events[:a]))).after(fold.summary(iter(events[a:b])))
        assert list(fold.walk(state, iter(events[b:]))) == whole[b:]


def test_walks_that_never_meet_carry_their_path():
    read_, error = ("file_read", "fail", None, None, "p", None, None), ("error_reveal", "fail", None, None, "E", None, None)
    events = [read_, read_, error] * 40
    s = fold.summary(iter(events))
    assert s.u_low != s.u_high and len(s.path) == 120
    met = fold.summary(iter([read_] * 40))
    assert met.u_low == met.u_high == 0.0 and met.path == b""
    whole = list(fold.walk(fold.State(), iter(events * 2)))
    state = fold.State().after(s)
    assert [r[5] for r in fold.walk(state, iter(events))] == [r[5] for r in whole[120:]]


def test_a_start_row_holds_what_a_part_needs():
    import pyarrow as pa

    events = [read(e) for e in made(1, 120, 3)]
    row = restarted(events[:60], events[60:])
    part = pa.table({"step": pa.array(range(60), pa.int32()), **{c: pa.array(v, pa.string() if i < 5 else pa.int64()) for i, (c, v) in enumerate(zip(fold.READS, zip(*events[60:], strict=True), strict=True))}})
    start = pa.StructArray.from_arrays([row[n].combine_chunks() for n, _ in fold._columns(fold.START_FIELDS)], names=[n for n, _ in fold._columns(fold.START_FIELDS)])
    got = fold.walked(part.append_column("start", start.take(pa.array([0] * part.num_rows))))
    whole = list(fold.walk(fold.State(), iter(events)))
    assert [tuple(r[n.split()[0]] for n in fold.ADDED.split(", ")) for r in got.to_pylist()] == whole[60:]


@pytest.mark.parametrize("size", [1, 7, 50])
def test_translation_in_parts(spark, monkeypatch, size):
    monkeypatch.setattr(T, "PART", size)
    trajectories = {t: made(t, n, t) for t, n in enumerate([0, 1, 2, 15, 60, 120, 300])}
    events = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in SCHEMA.split(", ")) for t in trajectories.values() for r in t], SCHEMA).repartition(5)
    names = ["type", "timestamp", "resource", "amount", "tool", "observable_added", "uncertainty", "from_phase", "to_phase", "phase", "cmd_label"]
    got = {}
    for r in T.translate(events).orderBy("task_id", "idx").collect():
        got.setdefault(r.task_id, []).append((r.idx, *[r[n] for n in names]))
    for t, evs in trajectories.items():
        assert got.get(t, []) == [(i, *[r.get(n) for n in names]) for i, r in enumerate(loop_translate(evs))]


def test_a_long_trajectory_is_many_groups(spark, monkeypatch):
    monkeypatch.setattr(T, "PART", 500)
    events = spark.range(20_000).selectExpr("1L as task_id", "cast(id as int) as step", "if(id % 3 = 0, 'error_reveal', 'file_read') as type", "concat('p', id % 50) as path")
    out = T.translate(events)
    assert out.count() == 20_000
    starts = T.part_starts(T.readable(events))
    assert starts.count() == 39  # every part of 500 steps but the first
    assert [r.seq for r in starts.orderBy("part").collect()] == list(range(500, 20_000, 500))
