"""Suffix dedup of anchors that are worked in parts: steps 1 to 3 without Spark, against the brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_op8 import brute

from seqlens.llm import op8_suffix_dedup as op


def steps(texts, size, heavy=None):
    """(bytes removed, runs) of each text."""
    rows = pa.Table.from_batches(op._find([pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in texts]))
    settled = [r for r in rows.to_pylist() if r["kind"] == op.SETTLED]
    rows = rows.filter(pc.equal(rows["kind"], op.OPEN))
    rows = rows.sort_by([("anchor", "ascending"), ("context", "ascending"), ("more", "ascending")]).combine_chunks()
    first = pa.Table.from_batches(op._settle(heavy)(rows.to_batches(max_chunksize=size)), rows.schema).to_pylist() + settled
    data = {op.text_key(t.encode()): t.encode() for t in texts}
    fetched = []
    for r in first:
        if r["kind"] == op.OPEN:
            own = data[r["t1"], r["t2"]][r["at"] - r["hi"] : r["at"] - r["lo"] + op.LENGTH]
            fetched.append([r[k] for k in ("anchor", "t1", "t2", "at", "lo", "hi")] + [own])
    fetched.sort()
    spans = [(r["t1"], r["t2"], r["at"], r["context"]) for r in first if r["kind"] == op.SETTLED]
    if fetched:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*fetched, strict=True), op._FETCHED, strict=True)], names=list("abcdefg"))
        second = [r for b in op._sorted_groups(heavy)([batch]) for r in b.to_pylist()]
        times = Counter((r["anchor"], r["context"]) for r in second if r["kind"] == op.OPEN)
        spans += [(r["t1"], r["t2"], r["at"], r["context"]) for r in second if r["kind"] == op.SETTLED]
        spans += [(r["t1"], r["t2"], r["at"], r["at"] + op.LENGTH) for r in second if r["kind"] == op.OPEN and times[r["anchor"], r["context"]] > 1]
    out = []
    for t in texts:
        cover = np.zeros(len(t.encode()) + 1, np.int8)
        for t1, t2, start, end in spans:
            if (t1, t2) == op.text_key(t.encode()):
                cover[start:end] = 1
        out.append((int(cover.sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum())))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot", [20_000, 3])
def test_parts_lose_nothing(monkeypatch, seed, hot):
    monkeypatch.setattr(op, "PART", 3, raising=False)
    monkeypatch.setattr(op, "HOT", hot)
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    line = word(100)
    tails = [word(150) for _ in range(5)]
    texts = [word(rnd.randint(100, 300)) + line + rnd.choice(tails)[: rnd.randint(60, 150)] + word(60) for _ in range(17)]
    texts.append(texts[0])
    want = [(removed, runs) for _, removed, runs, _ in brute(texts)]
    for size in (4, 5):
        assert steps(texts, size) == want
    anchors = {r["anchor"] for b in op._find([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]) for r in b.to_pylist()}
    assert steps(texts, 1000, sorted(anchors)) == steps(texts, 1000, sorted(anchors)[::2]) == want  # all heavy, every other one


def test_last_part_of_one_row():
    """At the true limit: an anchor of over a million contexts, the last of which stands in a part of its own."""
    n = 1_000_001
    zero, ones = np.zeros(n, np.int64), np.ones(n, np.int32)
    batch = op._rows(ones, zero, np.arange(n), zero, zero, np.arange(n), zero, ones * 0, ones * 0, ones)
    last = op._rows(ones[:1], zero[:1], np.array([n]), zero[:1], zero[:1], np.array([n]), zero[:1], ones[:1] * 0, ones[:1] * 0, ones[:1])
    got = [b.column(2) for b in op._settle()([batch, last])]
    assert sum(map(len, got)) == n + 1


def test_frequent_anchors():
    rnd = np.random.default_rng(3)
    tasks = [rnd.integers(0, 10**9, 5000) for _ in range(6)]
    for t in tasks[:3]:
        t[:400] = 7
    total = {}
    for t in tasks:
        halves = [pa.RecordBatch.from_arrays([pa.array(x)], names=["anchor"]) for x in (t[:2500], t[2500:])]
        for b in op._frequent(halves):
            assert b.num_rows <= 2 * op.SHARE
            for a, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[a] = total.get(a, 0) + n
    assert total[7] == 1200 and sum(n > 15 for n in total.values()) == 1
