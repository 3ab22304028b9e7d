"""Operators 4, 5, 6 and 10 against the libraries on a small table with nulls, repeats and long texts."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from seqlens.llm import op4_token_counts as op4
from seqlens.llm import op5_packing as op5
from seqlens.llm import op6_token_files as op6
from seqlens.llm import op10_sentencepiece as op10

LONG = "the cat sat on a mat " * 900
ROWS = [(1, "hello world", 0), (2, None, 1), (3, "", 2), (4, LONG, 3), (5, "hello world", 4), (5, "hello world", 5), (None, "x y z", 6), (7, "ärger <|endoftext|> 日本", 7)]
ROWS += [(k, f"word {k} " * (k % 50), k) for k in range(10, 120)]
SCHEMA = "doc_id long, text string, length long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def ids_of(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def key(x):
    return tuple((v is None, v) for v in x)


def test_counts_and_cache(spark, docs, tmp_path):
    of = ids_of("byte_bpe_50k.json")
    path = str(tmp_path / "cache")
    want = sorted(((d, len((t or "").encode()), len(of(t)), len(of(t)) > 512) for d, t, _ in ROWS), key=key)
    for _ in range(2):  # the second run finds all counts stored
        got = op4.token_counts(docs, P.path("byte_bpe_50k.json"), path)
        assert sorted(map(tuple, got.collect()), key=key) == want
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("content_digest").distinct().count() == len({t or "" for _, t, _ in ROWS})
    more = spark.createDataFrame([(1, "hello world"), (2, "brand new")], "doc_id long, text string")
    op4.token_counts(more, P.path("byte_bpe_50k.json"), path).collect()
    assert spark.read.parquet(path).count() == len({t or "" for _, t, _ in ROWS}) + 1
    assert op4.token_counts(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).collect() == []


def test_packing(spark, docs):
    of = ids_of("byte_bpe_50k.json")
    got = op5.pack(docs, P.path("byte_bpe_50k.json")).collect()
    by_text = sorted(((d, *[(s, len(p), crc(p), len(x)) for s in range(0, len(x), 1024) for p in [x[s : s + 1024]]]) for d, x in ((d, of(t) + [0]) for d, t, _ in ROWS)), key=str)
    want = sorted(((d, *p) for d, *ps in by_text for p in ps), key=key)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=key) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert op5.pack(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).collect() == []


def test_shortest_pack_first():
    rng = np.random.default_rng(0)
    for size in (16, 64, 1024):
        hist = {int(k): int(v) for k, v in zip(rng.integers(1, size + 1, 40), rng.integers(1, 500, 40), strict=True)}
        patterns = op5.shortest_pack_first(hist, size)
        used = {}
        for lengths, count in patterns:
            assert sum(lengths) <= size and count > 0
            for x in lengths:
                used[x] = used.get(x, 0) + count
        assert used == hist and len(patterns) <= 3 * len(hist)
        slots = op5._slots(patterns)
        for length, n in hist.items():
            own = sorted((lo, hi) for x, lo, hi, _, _ in slots if x == length)
            assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_token_files(spark, docs):
    of = ids_of("word_bpe_49k.json")
    got = op6.token_files(docs, P.path("word_bpe_49k.json")).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    at, want = 0, []
    for d, t, _ in rows:
        ids = [*of(t), 2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert op6.token_files(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).collect() == []


def test_shards(spark, monkeypatch, tmp_path):
    """Several ranges, each of several shards: starts run on over all of them."""
    docs = spark.createDataFrame([(k, "a b c " * (k % 7)) for k in range(300)], "doc_id long, text string").repartition(4)
    op6.write_token_files(docs, str(tmp_path / "t"), P.path("word_bpe_49k.json"), "word", 2, docs_per_range=20, most=100)
    got = sorted(map(tuple, op6.read_token_files(spark, str(tmp_path / "t")).collect()))
    at = 0
    for d, start, n, _ in got:
        assert start == at, d
        at += n
    assert spark.read.parquet(str(tmp_path / "t")).count() > 25


def test_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 8191, 8192, 20_000):
        for high in (1, 2, 300, 49_408, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 100:
                ids[rng.integers(0, n, 5)] = 2**32 - 1
            data = op6.encode_blocks(ids)
            assert (op6.decode_blocks(data) == ids).all()
            assert (op6.decode_blocks(data, 1, 2) == ids[8192:16384]).all()


def test_sentencepiece_rows(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t, _ in ROWS:
        ids = sp.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    got = op10.encode_decode(docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert op10.encode_decode(spark.createDataFrame([], SCHEMA), P.path("piece_bpe_32k.model")).collect() == []
