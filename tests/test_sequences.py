"""Compression, translation and chains against plain loops over the same events."""

import random

import pytest

from seqlens.operators import chains as H
from seqlens.operators import compress as C
from seqlens.operators import translate as T
from seqlens.schemas import CONSTRAINT_FIELDS

KINDS = ["bash_call", "file_read", "file_edit", "test_run", "error_reveal", "task_transition", "context_update", "unknown_kind"]
SCHEMA = (
    "task_id long, step int, type string, command string, path string, error_type string, outcome string, message string, reason string,"
    " from_phase string, to_phase string, tokens_used bigint, tokens_max bigint"
)


def made(task, n, seed):
    rnd = random.Random(seed)
    out = []
    for s in range(n):
        kind = rnd.choices(KINDS, [8, 5, 3, 3, 3, 2, 1, 1])[0]
        row = {"task_id": task, "step": s, "type": kind}
        if kind == "bash_call":
            row["command"] = rnd.choice(["ls", "ls", " pwd ", "make x", "make y", "run a b", ""])
        if kind in ("file_read", "file_edit"):
            row["path"] = rnd.choice(["", "p1", "p2", *[f"q{rnd.randrange(40)}" for _ in range(3)]])
        if kind == "test_run":
            row["outcome"] = rnd.choice(["pass", "fail", None])
        if kind == "error_reveal":
            row["error_type"], row["message"] = rnd.choice(["", "E1", "E2", f"X{rnd.randrange(40)}"]), "m" * rnd.randint(0, 200)
        if kind == "task_transition":
            row["from_phase"], row["to_phase"] = (rnd.choice(["unknown", "initial", "debugging", None, "hypothesis"]) for _ in "ab")
            row["reason"] = rnd.choice([None, "", "why", "r" * 70])
        if kind == "context_update":
            row["tokens_used"], row["tokens_max"] = rnd.choice([(None, None), (170_000, 0), (190_000, 200_000), (5, 10)])
        out.append(row)
    return out


@pytest.fixture(scope="module")
def trajectories():
    return {t: made(t, n, t) for t, n in enumerate([0, 1, 2, 15, 60, 90, 40, 120])}


@pytest.fixture(scope="module")
def events(spark, trajectories):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [tuple(r.get(n) for n in names) for t in trajectories.values() for r in t]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def cmd(e):
    return (e.get("command") or "").strip()


def by_task(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.task_id, []).append(tuple(r[c] for c in cols))
    return {t: sorted(v) for t, v in out.items()}


def loop_terminal(evs):
    noop = lambda e: e["type"] == "bash_call" and cmd(e) in C.NOOPS
    kept = [
        e for e, nxt in zip(evs, [*evs[1:], None], strict=False)
        if not noop(e) or (nxt and nxt["type"] in ("file_read", "file_edit", "bash_call") and not noop(nxt))
    ]
    for kind, value, empty in (("bash_call", cmd, True), ("file_read", lambda e: e.get("path") or "", False)):
        out = []
        for e in kept:
            if out and e["type"] == out[-1]["type"] == kind and value(e) == value(out[-1]) and (empty or value(e)):
                continue
            out.append(e)
        kept = out
    return kept


def test_terminal(events, trajectories):
    got = by_task(C.compress(events, "tb"), "step")
    for t, evs in trajectories.items():
        assert [s for (s,) in got.get(t, [])] == [e["step"] for e in loop_terminal(evs)]
    dropped = by_task(C.compression_log(events), "step", "reason")
    for t, evs in trajectories.items():
        assert len(evs) == len(got.get(t, [])) + len(dropped.get(t, []))


def test_patch(events, trajectories):
    got = by_task(C.compress(events, "swe").fillna(0, ["burst_size", "retry_count"]), "step", "command", "burst_size", "retry_count", "additional_paths", "message")
    for t, evs in trajectories.items():
        first, i = [], 0
        while i < len(evs):
            j = i
            while j < len(evs) and evs[j]["type"] == "file_read":
                j += 1
            if j - i >= 3:
                first.append(dict(evs[i], command="read_burst", burst_size=j - i, additional_paths=[e.get("path") or "" for e in evs[i + 1 : j]]))
                i = j
            else:
                first.append(dict(evs[i]))
                i += 1
        out = []
        for e in first:
            if out and e["type"] == out[-1]["type"] == "bash_call" and cmd(e) == cmd(out[-1]):
                out[-1]["retry_count"] = out[-1].get("retry_count", 1) + 1
            else:
                out.append(e)
        want = [
            (e["step"], e.get("command"), e.get("burst_size", 0), e.get("retry_count", 0), e.get("additional_paths"), (e.get("message") or "")[:120] if e["type"] == "error_reveal" else e.get("message"))
            for e in out
        ]
        assert got.get(t, []) == want


def test_sources(events):
    assert set(C.COMPRESSORS) == {"tb", "swe", "human"}
    with pytest.raises(ValueError, match="Unknown source"):
        C.compress(events, "other")


def loop_translate(evs):
    """The state machine, one event after the other."""
    files, cmds, errs = {}, {}, {}
    phase, used, most, patience, u = "exploration", 0, 200_000, 1.0, 0.5
    out_of, n_err, edited, last = False, 0, False, "command_1"
    rows = []
    for e in evs:
        kind, made_rows = e["type"], []
        if kind in ("bash_call", "context_update"):
            if kind == "bash_call":
                stem = (cmd(e).split() or ["unknown"])[0]
                cmds.setdefault(stem, f"command_{min(len(cmds), 25) + 1}")
                last = cmds[stem]
                used = min(used + 150, most)
            else:
                used, most = e.get("tokens_used") or 0, max(1, e.get("tokens_max") or 200_000)
            left = round(max(0.0, 1 - used / most), 3)
            made_rows.append(dict(type="ResourceBudget", resource="context_window", amount=left, decay="monotone_decrease"))
            if left < 0.2 and not out_of:
                out_of = True
                made_rows.append(dict(type="ToolAvailability", tool="context_window", state="unavailable"))
        elif kind in ("file_read", "file_edit"):
            path = e.get("path") or f"_unknown_{len(files)}"
            if path not in files:
                k = len(files)
                files[path] = f"file_{chr(65 + k)}" if k < 26 else f"file_OVERFLOW_{k - 25}"
            if kind == "file_read":
                u = max(0.0, u - 0.04)
                made_rows.append(dict(type="InformationState", observable_added=[files[path]], observable_removed=[], uncertainty=round(u, 3)))
            elif not edited or phase not in ("implementation", "debugging"):
                made_rows.append(dict(type="SubGoalTransition", from_phase=phase, to_phase="implementation", trigger="first_edit"))
                phase, edited = "implementation", True
            else:
                made_rows.append(dict(type="ToolAvailability", tool=files[path], state="available"))
        elif kind == "test_run":
            good = e.get("outcome") == "pass"
            to = "validation" if good else "debugging"
            if phase != to:
                made_rows.append(dict(type="SubGoalTransition", from_phase=phase, to_phase=to, trigger="test_pass" if good else "test_fail"))
                phase = to
            if good:
                made_rows.append(dict(type="OptimizationCriterion", objective="correctness_primary", weight_shift="correctness_increase"))
            else:
                patience = max(0.0, patience - 0.15)
                made_rows.append(dict(type="ResourceBudget", resource="patience_budget", amount=round(patience, 3), decay="monotone_decrease_if_turn_based"))
                made_rows.append(dict(type="ToolAvailability", tool="test_suite", state="unavailable", recover_in=3))
        elif kind == "error_reveal":
            name = e.get("error_type") or "RuntimeError"
            errs.setdefault(name, f"error_class_{chr(65 + min(len(errs), 25))}")
            u = min(1.0, u + 0.08)
            if n_err % 2 == 0:
                made_rows.append(dict(type="InformationState", observable_added=[errs[name]], observable_removed=[], uncertainty=round(u, 3)))
            else:
                made_rows.append(dict(type="CoordinationDependency", role="affected_module_M1", dependency=errs[name], expected_action=f"resolve_{errs[name]}"))
            n_err += 1
        elif kind == "task_transition":
            a = e.get("from_phase") if e.get("from_phase") in T.PHASES else phase
            b = e.get("to_phase") if e.get("to_phase") in T.PHASES else "exploration"
            if a == b:
                a, b = phase, "hypothesis" if phase == "exploration" else "exploration"
            phase = b
            made_rows.append(dict(type="SubGoalTransition", from_phase=a, to_phase=b, trigger=(e.get("reason") or "task_transition")[:50]))
        rows += [dict(r, timestamp=e["step"], phase=phase, cmd_label=last) for r in made_rows]
    return rows


def test_translate(events, trajectories):
    names = [n for n, _ in CONSTRAINT_FIELDS] + ["phase", "cmd_label"]
    got = {}
    for r in T.translate(events).orderBy("task_id", "idx").collect():
        got.setdefault(r.task_id, []).append((r.idx, *[r[n] for n in names]))
    for t, evs in trajectories.items():
        want = [(i, *[r.get(n) for n in names]) for i, r in enumerate(loop_translate(evs))]
        assert got.get(t, []) == want


def test_chains(spark, events, trajectories):
    rows = T.translate(events)
    kept = {}
    for r in H.observe(rows).orderBy("task_id", "idx").collect():
        kept.setdefault(r.task_id, []).append(r)
    for t, evs in trajectories.items():
        full = loop_translate(evs)
        first = {}
        for i, c in enumerate(full):
            for x in c.get("observable_added") or []:
                first.setdefault(x, i)
        want = [i for i, c in enumerate(full) if not (c["type"] == "ToolAvailability" and first.get(c["tool"], -1) > i)]
        assert [r.orig_idx for r in kept.get(t, [])] == want and [r.idx for r in kept.get(t, [])] == list(range(len(want)))
    chains, reasons = H.build_chains(rows, "tb")
    found = {r.task_id: r.reason for r in reasons.collect()}
    for r in H.validity(H.truncate(H.observe(rows))).collect():
        cs = [c for c in kept[r.task_id]][:40]
        n = lambda f: sum(map(f, cs))
        ok = 20 <= len(cs) <= 40 and n(lambda c: c.type == "SubGoalTransition") >= 2 and n(lambda c: c.state == "unavailable") >= 1
        ok = ok and n(lambda c: c.type == "ResourceBudget") >= 10
        same = any(all(a[f] == b[f] for f, _ in CONSTRAINT_FIELDS) for a, b in zip(cs, cs[1:], strict=False))
        assert r.valid == (ok and not same) and (found[r.task_id] == "filter_fail") == (not r.valid)


def test_permute_and_render(spark):
    rows = [(i, f"R{i}", float(20 - i) / 20, 3 * (i // 2)) for i in range(20)]
    fields = ", ".join(f"cast(null as {t}) as {n}" for n, t in CONSTRAINT_FIELDS if n not in ("type", "timestamp", "resource", "amount", "decay"))
    df = spark.createDataFrame(rows, "idx int, resource string, amount double, timestamp bigint").selectExpr(
        "'c' as task_id", "idx", "'ResourceBudget' as type", "timestamp", "resource", "amount", "'none' as decay", *fields.split(", "), "'exploration' as phase", "'command_1' as cmd_label"
    )
    one = H.assemble(df).selectExpr("task_id", "'c' as chain_id", "'c' as match_id", "constraints", "active_pairs")
    for r in H.permute(one).collect():
        seed = int(r.chain_id.rsplit("_", 1)[1])
        order = H.permutation(20, seed)
        assert [c.resource for c in r.constraints] == [f"R{i}" for i in order] and r.match_id == "c"
        assert [c.timestamp for c in r.constraints] == sorted(3 * (i // 2) for i in range(20))
    drawn = H.render(one, "tb", ["R3", "amount"]).first()
    assert drawn.rendered.startswith("# Constraint chain (perspective=tb)\nStep 1 (step=0):\n  ResourceBudget: R0 at 100.0%\nStep 2 (step=0):\n  ResourceBudget: R1 at 95.0%\n")
    assert drawn.leaked == ["R3"]
    p = H.prompts(one).first()
    assert p.cutoff_k == 10 and p.prompt.count("Step ") == 10 and "step 11." in p.prompt.replace("\n", " ")
    empty = H.render(one.selectExpr("task_id", "slice(constraints, 1, 0) as constraints")).first()
    assert empty.rendered.endswith("(no constraints)\n")
