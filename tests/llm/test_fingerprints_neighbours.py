"""Operators 1, 2, 7 and 9, and components, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from seqlens.llm import op1_fingerprints as op1
from seqlens.llm import op2_toxicity as op2
from seqlens.llm import op7_near_dedup as op7
from seqlens.llm import op9_nearest_neighbours as op9
from seqlens.llm.components import connected_components, join_components


def prose(rnd, n):
    return [f"w{rnd.randrange(900)}" for _ in range(n)]


def shingles(t):
    w = t.lower().encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_fingerprints(spark):
    rnd = random.Random(1)
    texts = {k: " ".join(prose(rnd, rnd.randint(0, 400))) for k in range(0, 900, 3)} | {1000: None, 1001: "é" * 7, 1002: ""}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, fingerprint int").repartition(6)
    got = {r.doc_id: r for r in op1.fingerprints(docs, docs_per_bucket=40).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for k, nxt in zip(order, [*order[1:], order[0]], strict=True):
        a, b = texts[k] or "", texts[nxt] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got[k]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == op1.to_text(op1.sketches([a])[0]) and r.edited_fingerprint == op1.to_text(op1.sketches([edited])[0])
        assert r.near_edited == op1.likeness(op1.from_text(r.fingerprint), op1.from_text(r.edited_fingerprint))
        x, y = set(shingles(a)), set(shingles(edited))
        if len(a) > 600:
            errors.append(abs(r.near_edited - len(x & y) / len(x | y)))
    assert np.mean(errors) < 0.06
    assert op1.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = op1.fingerprints(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = op1.fingerprints(spark.createDataFrame([(5, "a b"), (5, "a b"), (5, "c d"), (None, "e")], "doc_id long, text string")).collect()
    assert len(same) == 4


def plain_sketch(text):
    """The kept hashes by their definition, one word and one shingle at a time."""
    mask = 2**64 - 1

    def mix(x):
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * mult & mask
        return x ^ x >> 31

    odd = 0x9E3779B97F4A7C15
    words = []
    for w in text.lower().encode().split():
        h = sum((b + 1) * (mix((i % 4096 + 1) * odd & mask) | 1) for i, b in enumerate(w)) & mask
        words.append(mix((h + len(w) * odd) & mask))
    step = [mix(k * odd & mask) | 1 for k in range(101, 106)]
    if not words:
        return []
    parts = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
    hashes = [mix((sum(w * s for w, s in zip(p, step, strict=False)) + (len(p) if len(p) < 5 else 0)) & mask) for p in parts]
    return sorted({h >> 30 & 0xFFFFFFFF for h in hashes if h < 1 << 62})


def test_fingerprints_by_brute_force(spark):
    rnd = random.Random(6)
    base = prose(rnd, 300)
    texts = [" ".join(base[: rnd.randint(0, 300)] + prose(rnd, rnd.randint(0, 60))) for _ in range(60)] + ["a b", "", "é É x", "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [plain_sketch(t) for t in texts]
    for r in op1.fingerprints(docs, docs_per_bucket=10).collect():
        assert r.fingerprint.split(":")[2] == "".join(f"{h:08x}" for h in want[r.doc_id])
        a, b = set(want[r.doc_id]), set(want[r.doc_id - 1])
        like = 1.0 if texts[r.doc_id] == texts[r.doc_id - 1] else len(a & b) / len(a | b) if a | b else 0.0
        assert np.isclose(r.near_next, like), r.doc_id


def test_sketch_merge():
    rnd = random.Random(2)
    a, b = prose(rnd, 3000), prose(rnd, 300)
    whole = op1.sketches([" ".join(a + b)])[0][1]
    parts = [op1.sketches([" ".join(x)])[0][1] for x in (a, a[-4:] + b)]
    assert (op1.merge(*parts) == whole).all()
    assert op1.containment(parts[1], whole) == 1.0


def near_texts(rnd):
    base = [prose(rnd, rnd.randint(60, 200)) for _ in range(15)]
    out = []
    for w in base:
        out.append(w)
        for _ in range(rnd.randint(0, 25)):  # copies of copies: chains of links
            v = list(rnd.choice(out[-5:]))
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = f"e{rnd.randrange(10**6)}"
            out.append(v)
    return [" ".join(w) for w in out] + ["", " ", "one two", "one two", "one  two", "three"] + [" ".join(base[0])] * 5


@pytest.mark.parametrize("block", [2000, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(op7, "BLOCK", block)
    texts = near_texts(random.Random(7))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(4)
    got = {r.doc_id: r for r in op7.near_duplicates(docs).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = (sets[i] & sets[j]).total()
            every = sets[i].total() + sets[j].total() - both
            if texts[i] == texts[j] or (every and both / every >= 0.8):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: got[i].group_id for i in got} == {i: find(i) for i in range(len(texts))}
    kept = op7.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))}) == sorted(i for i in got if got[i].keep)


def test_near_edges(spark):
    schema = "doc_id long, text string"
    assert op7.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a"), (3, "a"), (4, None), (5, ""), (3, "a")]
    got = {(r.doc_id, r.group_id, r.group_size) for r in op7.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 3, 3), (3, 3, 3), (4, 4, 2), (5, 4, 2)}
    assert sorted(r.doc_id for r in op7.drop_near_duplicates(spark.createDataFrame(rows, schema)).collect()) == [3, 4]


def test_dart_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    found = []
    for _ in range(40):
        ids = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a = rng.integers(1, 9, 200).astype(float)
        b = np.where(rng.random(200) < 0.6, a, rng.integers(1, 9, 200))
        s = op7.signatures(np.concatenate([ids, ids]), np.concatenate([a, b]), np.array([200, 400]))
        found.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(found)) < 0.03


def test_repeated_rows_and_clashing_names(spark):
    names = ["doc_id", "text", "digest", "row", "id", "n", "group_id", "a.b", "__own", "__digest", "__row"]
    schema = ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names)
    text = " ".join(prose(random.Random(9), 80))
    texts = [(3, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c"), (1, text), (2, text + " x"), (None, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, *"abcdefghi") for d, t in texts], schema).repartition(3)
    got = op7.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    kept = Counter(r.group_id for r in got if r.keep)
    assert kept == Counter({3: 1, 1: 1, None: 1}) and {r.group_id: r.group_size for r in got} == {3: 4, 1: 2, None: 3}
    left = op7.drop_near_duplicates(docs)
    assert left.columns == names
    assert sorted((r[0] or 0, *r[2:]) for r in left.collect()) == [(k, *"abcdefghi") for k in (0, 1, 3)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6)] + [(k, k + 1) for k in range(100, 180)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | dict.fromkeys(range(100, 181), 100)
    roots = connected_components(spark.createDataFrame([(1, 2), (4, 5), (8, 9)], "a long, b long"), "a", "b")
    more = spark.createDataFrame([(2, 5), (20, 9)], "a long, b long")
    got = {r.node: r.root for r in join_components(roots, more, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 8}


def test_toxicity(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for k in range(1500):
        words = prose(rnd, rnd.randint(5, 150))
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "moron", "zorgu" + rnd.choice(["la", "mi", "tes", "ban"])]))
        rows.append((k, " ".join(words)))
        if k % 2:
            labels.append((k, 1, int(bad)))
    truth = {k: ("idiot" in t or "moron" in t or "zorgu" in t) for k, t in rows}
    rows += [(None, "fine"), (9999, None), (9998, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op2.score(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [bool(r.predicted) == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.97
    none = op2.score(docs, lab.limit(0)).collect()
    assert len(none) == len(rows)
    assert op2.score(docs.limit(0), lab).collect() == []
    kept = op2.reject_toxic(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_grammar():
    s = op2.Scorer({})
    kinds = lambda t: {k for k, v in zip(op2.KINDS, s.features(t), strict=True) if v}
    assert kinds("you are an idiot.") == {"insult_at"}
    assert kinds("what an idiot.") == {"insult"}
    assert kinds("idiot, you know") == {"insult"}
    assert kinds("he is not an idiot.") == {"negated"}
    assert kinds("she said that he is an idiot. fine") == {"reported"}
    assert kinds("I will kill you") == {"threat_at"}
    assert kinds("nice day") == set()


def by_definition(tape):
    """Counts of kinds, each match judged by what stands around it."""
    out = {k: 0 for k in op2.KINDS}
    hits, ends = {op2.INSULT, op2.WEAK, op2.THREAT}, {op2.CLAUSE, op2.SENTENCE}
    for i, x in enumerate(tape):
        if x not in hits:
            continue
        sentence = max((k for k in range(i) if tape[k] == op2.SENTENCE), default=-1) + 1
        clause = max((k for k in range(i) if tape[k] in ends), default=-1) + 1
        if op2.NOT in tape[max(clause, i - 3) : i]:
            out["negated"] += 1
        elif op2.SAID in tape[sentence:i]:
            out["reported"] += 1
        elif x == op2.WEAK:
            out["weak"] += 1
        else:
            after = tape[i + 1 : i + 3]
            stop = next((k for k, y in enumerate(after) if y in hits | ends), len(after))
            directed = op2.TARGET in tape[max(sentence, i - 3) : i] or op2.TARGET in after[:stop]
            out[("insult" if x == op2.INSULT else "threat") + ("_at" if directed else "")] += 1
    return out


def test_grammar_by_brute_force():
    rnd = random.Random(8)
    word = {op2.OTHER: "word", op2.INSULT: "idiot", op2.WEAK: "weakling", op2.THREAT: "kill", op2.TARGET: "you", op2.NOT: "not", op2.SAID: "said", op2.CLAUSE: ",", op2.SENTENCE: "."}
    s = op2.Scorer({"=weakling": op2.WEAK})
    for _ in range(3000):
        tape = "".join(rnd.choices(list(word), weights=[6, 3, 2, 2, 3, 2, 1, 1, 1], k=rnd.randint(0, 25)))
        text = " ".join(rnd.choice([word[x], "\n"]) if x == op2.SENTENCE else word[x] for x in tape)
        want = by_definition(tape + op2.SENTENCE)
        assert np.allclose(s.features(text), [np.log1p(want[k]) for k in op2.KINDS]), text
        x = s.features(text)
        assert np.isclose(s.score(np.array([x]))[0], 1 / (1 + np.exp(-(op2.BIAS + sum(w * v for w, v in zip(op2.KINDS.values(), x, strict=True))))))


def test_toxicity_ties_and_clashing_names(spark):
    texts = ["you are an idiot", "nice day", "you are an idiot", None]
    rows = [(i, t, 9.0, "x", 7, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, __score string, predicted int, held_out string")
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op2.score(docs, labels).collect()}
    assert got[0].score == got[2].score > got[1].score == got[3].score
    kept = op2.reject_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} <= {(9.0, "x", 7, "y")}


def test_line_breaks_end_sentences():
    s = op2.Scorer({})
    kinds = lambda t: {k for k, v in zip(op2.KINDS, s.features(t), strict=True) if v}
    assert kinds("he said hello\nyou are an idiot") == {"insult_at"}
    assert kinds("he said  hello \t you are an idiot") == {"reported"}


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5020, [float("nan")] * 24, 0), (5040, [None] * 24, 0), (None, x[0].tolist(), 0), (5060, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = op9.nearest(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    full = x.astype(np.float64)
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in [r.vec_id for r in rs]
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        s = full @ full[q]
        s[q] = -np.inf
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rs)
        hits += len({r.vec_id for r in rs} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9
    few = op9.nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, score int")).collect()
    assert len(few) == 4
    assert op9.nearest(df.limit(0)).collect() == []


def test_nearest_of_several_lengths(spark):
    rng = np.random.default_rng(7)
    x = {i: rng.standard_normal(8 if i < 60 else 5).astype(np.float32) for i in range(100)}
    x[200] = rng.standard_normal(11).astype(np.float32)  # one longer stray
    rows = [(i, v.tolist()) for i, v in x.items()]
    got = op9.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), k=4).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80}
    hits = 0
    for q in (0, 20, 40, 60, 80):
        s = {i: float(v.astype(np.float64) @ x[q].astype(np.float64)) for i, v in x.items() if i != q and len(v) == len(x[q])}
        found = {r.vec_id: r.score for r in got if r.query_id == q}
        assert len(found) == 4 and all(abs(s[i] - score) < 1e-9 for i, score in found.items())
        hits += len(set(found) & set(sorted(s, key=lambda i: (-s[i], i))[:4]))
    assert hits >= 18


def test_few_pairs_are_verified():
    """On random vectors, the hardest case, a few per cent reach the threshold; in clusters less than one."""
    rng = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    clusters = rng.standard_normal((100, 64))[rng.integers(0, 100, 8192)] + 0.3 * rng.standard_normal((8192, 64))
    for x, most in ((unit(rng.standard_normal((16384, 64))), 0.05), (unit(clusters), 0.02)):
        n = len(x)
        index = op9.BlockIndex(np.arange(n), x)
        asked = np.arange(0, n, n // 100)
        qi, vi, score, verified = index.search(asked, x[asked])
        assert verified / (len(asked) * n) <= most
        hits = 0
        for i, a in enumerate(asked.tolist()):
            s = x.astype(np.float64) @ x[a].astype(np.float64)
            s[a] = -np.inf
            assert np.allclose(score[qi == i], s[vi[qi == i]])
            hits += int((s[vi[qi == i]] >= np.partition(s, n - 20)[n - 20] - 1e-9).sum())
        assert hits >= 0.94 * 20 * len(asked)


def test_double_vectors_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(40)]
    got = op9.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert {r.vec_id for r in got if r.query_id == 0} == {37, 38, 39}
    assert all(r.score == rows[r.vec_id][1][0] * rows[r.query_id][1][0] + 1.0 for r in got)


def test_common_words_crowd_out_no_lexeme(spark):
    rnd = random.Random(3)
    common = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(900)]  # a word and three beginnings each
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:81]
    toxic = {i: int(k < 41) for k, i in enumerate(ids)}
    texts = [(i, " ".join(rnd.sample(common, 900) + ["zorgblat"] * (k < 30))) for k, i in enumerate(ids)]
    learned, _ = op2.train(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    assert learned == {"=zorgblat": op2.INSULT}


def searched(x, asked, k=20):
    """What the blocks of a table find, without Spark: hits, and the share of pairs verified."""
    from collections import Counter

    full = x.astype(np.float64)
    cls = np.floor(np.log2(op9.norms(x)) * op9.CLASSES + op9.SHIFT).astype(int)
    counts = [{"length": x.shape[1], "class": c, "n": n} for c, n in Counter(cls.tolist()).items()]

    class Row(dict):
        __getattr__ = dict.get

    deals, _, _, _ = op9._dealt([Row(c) for c in counts], 20)
    share = {c: s / op9._HASHES for _, c, _, _, s in deals}
    seed = np.random.default_rng(3).random(len(x)) < np.array([share[c] for c in cls.tolist()])
    ids = np.arange(len(x))
    pilot = full[seed]
    high = op9.norms(pilot).max()
    q = full[asked] / op9.norms(full[asked])[:, None]
    least = op9.bounds(asked, q, ids[seed], pilot / high, k)
    found, verified = [[] for _ in asked], 0
    for c in set(cls.tolist()):
        own = np.flatnonzero(cls == c)
        index = op9.BlockIndex(own, x[own], seed[own])
        qi, vi, score, n = index.search(asked, x[asked], k, least=least * high / index.most - 1e-9)
        verified += n
        for i, v, s in zip(qi.tolist(), vi.tolist(), score.tolist(), strict=True):
            found[i].append((-s, int(own[v])))
    hits = 0
    for i, a in enumerate(asked.tolist()):
        s = full @ full[a]
        s[a] = -np.inf
        best = sorted(found[i])[:k]
        assert len(best) == k
        hits += sum(-b[0] >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 for b in best)
    return hits / (k * len(asked)), verified / (len(asked) * len(x))


def test_norms_of_all_kinds():
    """Recall and the share of pairs verified with equal norms, one outlier, and norms that vary widely."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, 8192, 160)
    scale = {"unit": np.ones(8192), "lognormal": np.exp(rng.standard_normal(8192))}
    for factor in (3, 10, 100):
        scale[f"one of {factor}"] = np.where(np.arange(8192) == 77, factor, 1.0)
    for name, norm in scale.items():
        recall, verified = searched((x * norm[:, None]).astype(np.float32), asked)
        assert recall >= 0.9 and verified < 0.1, (name, recall, verified)


def test_vectors_past_the_range_of_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** (200 if i % 40 == 1 else -200 if i % 20 == 0 else 0)).tolist()) for i in range(200)]
    got = op9.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 200, 20)) and all(len(v) == 5 for v in by.values())
    x = {i: np.array(v) for i, v in rows}
    for q, found in by.items():
        s = sorted((-float(x[q] @ x[i]), i) for i in x if i != q)[:5]
        assert sum(r.vec_id in {i for _, i in s} for r in found) >= 4


def test_nearest_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    for name in ("length", "class", "hash", "seed", "first", "blocks", "pilot", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    got = op9.nearest(df, k=3).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got if r.query_id == 20} == {(20, 1, 59), (20, 2, 58), (20, 3, 57)}
