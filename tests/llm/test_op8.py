"""Suffix dedup against a brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from seqlens.llm import op8_suffix_dedup as op


def brute(texts):
    seen = {}
    data = [t.encode() for t in texts]
    for i, d in enumerate(data):
        for s in range(len(d) - op.LENGTH + 1):
            seen.setdefault(d[s : s + op.LENGTH], []).append((i, s))
    cover = [np.zeros(len(d), bool) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + op.LENGTH] = True
    out = []
    for d, c in zip(data, cover, strict=True):
        kept = bytes(np.frombuffer(d, np.uint8)[~c]) if len(d) else b""
        runs = int((np.diff(np.concatenate([[0], c.astype(np.int8)])) == 1).sum())
        out.append((len(d), int(c.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rnd.randint(30, 90)) for _ in range(6)]
    texts = ["", "short", "x" * 900, "ab" * 400, "ab" * 300 + "c" + "ab" * 200]
    for _ in range(40):
        parts = [prose(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a, b = sorted(rnd.randint(0, len(s)) for _ in range(2))
            parts += [s[a:b] if rnd.random() < 0.7 else s, prose(rnd.randint(0, 20))]
        texts.append(rnd.choice(["", " ", "\n"]).join(parts))
    return texts + texts[7:10] + ["x" * 200 + "y"]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("hot", "heavy"), [(20_000, 2_000), (3, 2_000), (20_000, 4)])
def test_brute_force(spark, monkeypatch, seed, hot, heavy):
    monkeypatch.setattr(op, "HOT", hot)
    monkeypatch.setattr(op, "HEAVY", heavy)
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_sort_and_collisions(monkeypatch):
    rnd = np.random.default_rng(5)
    rows = rnd.integers(0, 3, (300, 12)).astype(np.uint16)
    group = np.sort(rnd.integers(0, 9, 300))
    want = np.lexsort((*rows.T[::-1], group))
    order, shared = op.suffix_sort(rows, group)
    assert (rows[order] == rows[want]).all() and (group[order] == group).all()
    monkeypatch.setattr(op, "prefix_hashes", lambda r: np.zeros((len(r), r.shape[1] + 1), np.uint64))  # all collide
    order, again = op.suffix_sort(rows, group)
    assert (rows[order] == rows[want]).all() and (again == shared).all()


def test_edges(spark):
    schema = "doc_id long, text string, n_chars long"
    assert op.remove_repeats(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, 0), (1, None, None), (1, "z" * 250, 250), (1, "z" * 250, 250)]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in op.remove_repeats(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (250, 250, 1), (250, 250, 1)]
    cut = op.cut_repeats(spark.createDataFrame(rows, schema))
    assert cut.columns == ["doc_id", "text", "n_chars"]
    assert sorted(map(tuple, cut.collect()), key=str) == sorted([(None, None, 0), (1, None, None), (1, "", 0), (1, "", 0)], key=str)


def test_clashing_names(spark):
    names = ["text", "t1", "t2", "spans", "row", "none", "part", "a.b", "__text", "__t1", "n_chars", "doc_id"]
    rows = [("z" * 250 + "é", *"123456789", 251, 1), ("y" * 90, *"123456789", 90, 2)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('n_chars', 'doc_id') else 'string'}" for n in names))
    cut = op.cut_repeats(docs)
    assert cut.columns == names
    got = sorted(map(tuple, cut.collect()))
    assert got == [("y" * 90, *"123456789", 90, 2), ("é", *"123456789", 1, 1)]
    assert op.remove_repeats(docs).count() == 2
