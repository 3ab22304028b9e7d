"""The pipeline against its stages on a small corpus, and the registry."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from seqlens.llm import op5_packing, op7_near_dedup, op8_suffix_dedup


def write(spark, tmp_path):
    rnd = random.Random(11)
    prose = lambda n: " ".join(f"t{rnd.randrange(5000)}" for _ in range(n))
    shared = prose(70)
    texts = [prose(rnd.randint(30, 120)) for _ in range(60)]
    near = texts[0].split()
    near[5] = "changed"
    texts += [texts[1], " ".join(near) if len(near) > 60 else texts[0]]
    texts += [f"{prose(60)} {shared} {prose(50)}" for _ in range(3)]
    toxic = [f"{prose(20)} you idiot {prose(20)} stupid moron" for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + toxic)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= len(texts))) for i in range(len(rows)) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return texts, toxic, shared


def test_stages(spark, tmp_path):
    texts, toxic, shared = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in seen["toxicity"].collect()} == set(range(len(texts)))
    kept = {r.doc_id for r in seen["near_dedup"].collect()}
    groups = op7_near_dedup.near_duplicates(seen["toxicity"]).collect()
    assert kept == {r.group_id for r in groups} and len(kept) == len(texts) - 2
    cut = {r.doc_id: r for r in seen["suffix_dedup"].collect()}
    assert set(cut) == kept
    assert all(shared not in r.text and r.n_chars == len(r.text) for r in cut.values())
    clean = [i for i in kept if shared not in texts[i]]
    assert all(cut[i].text == texts[i] for i in clean)
    packed = {(r.doc_id, r.start): r.length for r in seen["packing"].collect()}
    want = {(r.doc_id, r.start): r.length for r in op5_packing.pack(seen["suffix_dedup"], __import__("public_tokenizers").path("byte_bpe_50k.json")).collect()}
    assert packed == want
    whole = {(r.doc_id, r.start): r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == want
    assert op8_suffix_dedup.LENGTH == 200


def brute_force(texts, toxic):
    """The pipeline by plain means: (doc_id, start, length, crc32) of all pieces."""
    import zlib
    from array import array
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {i: t for i, t in enumerate(texts + toxic) if "idiot" not in t}  # planted words tell toxic ones
    sets = {}
    for i, t in docs.items():
        w = t.lower().split()
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in docs}
    for i in docs:
        for j in docs:
            both = (sets[i] & sets[j]).total()
            if j < i and both / (sets[i].total() + sets[j].total() - both) >= 0.8:
                old, new = root[i], root[j]
                root = {k: min(old, new) if r in (old, new) else r for k, r in root.items()}
    data = {i: docs[i].encode() for i in docs if root[i] == i}
    places = {}
    for i, d in data.items():
        for s in range(len(d) - 199):
            places.setdefault(d[s : s + 200], []).append((i, s))
    cover = {i: np.zeros(len(d), bool) for i, d in data.items()}
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                cover[i][s : s + 200] = True
    byte, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for i, d in data.items():
        kept = bytes(np.frombuffer(d, np.uint8)[~cover[i]]).decode("utf-8", "ignore")
        ids = [*byte.encode(kept, add_special_tokens=False).ids, 0]
        out |= {(i, s, len(p), zlib.crc32(array("I", p).tobytes())) for s in range(0, len(ids), 1024) for p in [ids[s : s + 1024]]}
    return out


def test_brute_force(spark, tmp_path):
    texts, toxic, _ = write(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in got} == brute_force(texts, toxic)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert sum(n for _, n in p) <= 1024 and sorted(p) == [(sum(n for _, n in sorted(p)[:k]), n) for k, (_, n) in enumerate(sorted(p))]


def test_registry():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert not set(__spark_entry__.oracle_sql()) - set(names)


@pytest.mark.parametrize("missing", [True, False])
def test_optional(monkeypatch, missing):
    if missing:
        assert __spark_entry__._optional("seqlens.llm.absent_module") is None
    else:
        assert __spark_entry__._optional("corpus_pipeline") is corpus_pipeline
