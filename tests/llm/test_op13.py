"""Turn repair against trying every edit (short conversations) and a forward search over whole audits (longer ones)."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seqlens.llm import op13_turn_repair as op

SCHEMA = "conv_id long, turn long, role string, text string"
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(how, 1))
    return {c: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, t in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(turns, bad):
    """Least (cost, audit) and its turns over all edits with up to two insertions before, between and after turns."""
    each = []
    for (_, role, text), fault in zip(turns, bad, strict=True):
        ways = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            ways += [(more, "K", [(role, text)])] + [(more + 3, "R", [(r, text)]) for r in NAME.values()]
        each.append(ways)
    puts = [(3 * k, "I" * k, [(r, "") for r in p]) for k in range(3) for p in itertools.product(NAME.values(), repeat=k)]
    slots = [puts]
    for ways in each:
        slots += [ways, puts]
    best = None
    for parts in itertools.product(*slots):
        done = [t for p in parts for t in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in done)):
            key = (sum(p[0] for p in parts), "".join(p[1] for p in parts), done)
            best = key if best is None or key[:2] < best[:2] else best
    return best


def forward(turns, bad):
    """The same over states with whole audits: per last role (and none), the least (cost, audit, turns)."""
    states = {"": (0, "", [])}
    needs = lambda q, r: {("", "a"): "u", ("s", "a"): "u", ("u", "u"): "a", ("a", "a"): "u"}.get((q, r), "")
    for (_, role, text), fault in zip(turns, bad, strict=True):
        new = {q: (c + 4, t + "D", x) for q, (c, t, x) in states.items()}
        for q, (c, t, x) in states.items():
            for r in "sua" if fault not in ("blank", "duplicate") else "":
                if r == "s" and (q or role[:1] != "s"):
                    continue
                put = needs(q, r)
                keep = role[:1] == r
                way = (c + 3 * len(put) + (0 if keep else 3) + (3 if fault == "truncated" else 0), t + "I" * len(put) + "RK"[keep])
                made = x + [(NAME[p], "") for p in put] + [(role if keep else NAME[r], text)]
                if r not in new or way < new[r][:2]:
                    new[r] = (*way, made)
        states = new
    ends = {"": "", "s": "ua", "u": "a", "a": ""}
    return min(((c + 3 * len(ends[q]), t + "I" * len(ends[q]), x + [(NAME[p], "") for p in ends[q]]) for q, (c, t, x) in states.items()), key=lambda w: w[:2])


def want(rows, best=forward):
    out = []
    for conv, turns in damage(rows).items():
        bad = faults(turns)
        cost, audit, done = best(turns, bad)
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, gaps, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in op.audits(op.damaged(df)).select(*(x.split()[0] for x in op.SUMMARY.split(", "))).collect()), key=repr)


def some(conversations, longest, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", "Why? ", "", " \n", None, "cut of", f"Turn {t}.", "é…", "end.\t\x0b"])
            rows.append((c, rng.choice([t, t, t, t * 2, None]), role, text))
    return rows


def test_every_edit_of_short_conversations(spark):
    rows = some(120, 2, 1)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want(rows, every_edit)


@pytest.mark.parametrize("seed", [2, 3])
def test_longer_conversations(spark, seed):
    rows = some(200, 14, seed) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yo."), (None, None, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == want(rows)


def test_one_conversation_over_many_batches(spark):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", "x", "again."])) for t in range(3000)] + [(6, 0, "user", "Hi.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == want(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_conversations_of_which_nothing_is_left(spark):
    gone = [(c, 7, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:7".encode()) % 20 == 0]
    got = found(spark.createDataFrame(gone, SCHEMA))
    assert len(got) == len(gone) > 5
    assert {r[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table_clashing_names_and_very_long_texts(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [*some(20, 6, 4), (99, 0, "user", "long. " * 300_000), (99, 1, "assistant", "a" + " " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("copies", "first", "fault", "rest", "step", "edit", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    assert found(df) == want(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (1, 2, "user", "Hi there."), (2, 0, "user", " ")]
    df = op.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "step")
    got = [(r.conv_id, r.role, r.text) for r in df.collect()]
    assert got == [(1, "user", ""), (1, "assistant", "Hello."), (1, "user", "Hi"), (1, "assistant", "Hi there.")]
