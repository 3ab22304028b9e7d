"""Every operator on a table with very long texts and a large group of copies."""

import hashlib
import random
import zlib
from array import array

import public_tokenizers as P
import pytest

from seqlens.llm import op1_fingerprints as op1
from seqlens.llm import op2_toxicity as op2
from seqlens.llm import op4_token_counts as op4
from seqlens.llm import op5_packing as op5
from seqlens.llm import op6_token_files as op6
from seqlens.llm import op7_near_dedup as op7
from seqlens.llm import op8_suffix_dedup as op8
from seqlens.llm import op10_sentencepiece as op10

COPIES = 3000


def made():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8)))
    prose = " ".join(word() for _ in range(80_000))  # about 480,000 characters
    near = prose[:200_000] + " changed " + prose[200_000:]
    texts = {1: prose, 2: near, 3: " " * 1_000_000, 4: "".join(rnd.choices("abcdefgh", k=300_000)), 5: "x " * 250_000, 6: "a short text", 7: None}
    copy = " ".join(word() for _ in range(60))
    return texts | {k: copy for k in range(10, 10 + COPIES)}


TEXTS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(4).cache()


def text(k):
    return TEXTS[k] or ""


def test_fingerprints(docs):
    got = {r.doc_id: r for r in op1.fingerprints(docs).select("doc_id", "n_chars", "near_next", "edited_sha256").collect()}
    assert len(got) == len(TEXTS) and all(got[k].n_chars == len(text(k)) for k in TEXTS)
    assert got[2].near_next > 0.99 and got[11].near_next == 1.0
    half = len(text(2)) // 2
    assert got[2].edited_sha256 == hashlib.sha256((text(2)[: len(text(2)) - half] + text(1)[:half]).encode()).hexdigest()


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (10, 1, 1), (12, 1, 1)], "doc_id long, quality int, toxic int")
    got = op2.score(docs, labels).collect()
    assert len(got) == len(TEXTS) and len({r.score for r in got if r.doc_id >= 10}) == 1


def test_tokens(docs, tmp_path):
    from tokenizers import Tokenizer

    byte, word = (Tokenizer.from_file(P.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    memo = {}

    def ids(t, k):
        key = (id(t), text(k))
        if key not in memo:
            memo[key] = t.encode(text(k), add_special_tokens=False).ids
        return memo[key]

    counts = {r.doc_id: r.n_tokens for r in op4.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert counts == {k: len(ids(byte, k)) for k in TEXTS}
    pieces = {}
    for r in op5.pack(docs, P.path("byte_bpe_50k.json")).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for k in TEXTS:
        every, at = [*ids(byte, k), 0], 0
        for start, length, crc in sorted(pieces[k]):
            assert start == at and crc == zlib.crc32(array("I", every[start : start + length]).tobytes())
            at += length
        assert at == len(every)
    at = 0
    for r in sorted(op6.token_files(docs, P.path("word_bpe_49k.json")).collect(), key=lambda r: r.doc_id):
        every = [*ids(word, r.doc_id), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(every), zlib.crc32(array("I", every).tobytes()))
        at += len(every)


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in op7.near_duplicates(docs).collect()}
    assert got[1].group_id == got[2].group_id == 1 and {got[k].group_id for k in range(10, 10 + COPIES)} == {10}
    assert sum(r.keep for r in got.values()) == len({r.group_id for r in got.values()})
    assert got[10].group_size == COPIES and all(got[k].group_id == k for k in (3, 4, 5, 6) if text(k).strip())


def test_repeats(docs):
    got = {r.doc_id: r for r in op8.remove_repeats(docs).collect()}
    n = len(text(1))
    assert got[1].n_removed >= n - 200 and got[2].n_removed >= n - 400
    assert got[3].n_removed == 1_000_000 and got[5].n_removed == 500_000 and got[4].n_removed == got[6].n_removed == 0
    assert all(got[k].n_removed == len(text(10)) and got[k].n_spans == 1 for k in range(10, 10 + COPIES))


def test_pieces(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {t: ",".join(map(str, sp.encode(t))) for t in {text(k) for k in TEXTS}}
    for r in op10.encode_decode(docs, P.path("piece_bpe_32k.model")).collect():
        assert r.ids_sha256 == hashlib.sha256(want[text(r.doc_id)].encode()).hexdigest()


def test_held_out_accuracy(spark):
    """On the corpus itself: labels that were not seen are told from the text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = op2.score(docs, labels).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert len(toxic) > 50 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)
