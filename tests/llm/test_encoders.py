"""Encoders against the libraries."""

import random
from array import array

import public_tokenizers as P
import pytest

from seqlens.llm.fastenc import Encoder
from seqlens.llm.op10_sentencepiece import PieceModel

ODD = [
    "", " ", "  ", " a  b ", "a\n \nb", "\n x", "x\n", " <|endoftext|> a", "a<|endoftext|>b  c", "don't we'll\tgo \t\t x", "a" * 3000, "\x01 \x00",
    "é ́x İ Σ ΑΣ ²½", "日本語 テスト 🙂👩‍👩‍👧", "\x1c \x1d a\r\n", "'s 't 'LL ''S", "a_b__ c_1", "▁a a▁▁b", "<s>x</s> <unk> <0x41>", "ab" * 500, "1234567890" * 30, "�",
]


def texts(n=1500, seed=3):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(" \n\ta▁•1é'<|endoftext|>.,🙂A½日Thnear") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids(name, kind):
    e = Encoder(P.path(name), kind)
    for t, got in zip(texts(), e.encode(texts()), strict=True):
        assert got == array("I", e.lib.encode(t, add_special_tokens=False).ids).tobytes(), t


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_every_admitted_character(name, kind):
    e = Encoder(P.path(name), kind)
    for c in range(0x20, 0x3000):
        if not e.other.search(chr(c)):
            t = f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}"
            assert e.encode([t])[0] == array("I", e.lib.encode(t, add_special_tokens=False).ids).tobytes(), hex(c)


def test_sentencepiece():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    all_texts = texts()
    for t, words, want in zip(all_texts, model.encode(all_texts), sp.encode(all_texts), strict=True):
        ids = [i for w, _ in words for i in w]
        assert ids == want, t
        assert model.decode(ids) == sp.decode(ids), t
    rnd = random.Random(1)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), 1, 2, 0]) for _ in range(rnd.randint(0, 6))]
        assert model.decode(ids) == sp.decode(ids), ids


def long_texts():
    rnd = random.Random(2)
    point = lambda: chr(rnd.choice([rnd.randrange(0x41, 0x5B), rnd.randrange(0x4E00, 0x9000), rnd.randrange(0xE0, 0xFF)]))
    letters, mixed = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "".join(point() for _ in range(1_000_000))
    return [" " * 5_000_000, "a" * 5_000_000, mixed, letters, "\n \t" * 200_000 + "x", "ther" * 100_000, "!?" * 100_000, "x " + " " * 9_999 + "y"]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_long_runs(name, kind):
    e = Encoder(P.path(name), kind)
    for t in long_texts():
        assert e.encode([t])[0] == array("I", e.lib.encode(t, add_special_tokens=False).ids).tobytes(), t[:20]


def test_sentencepiece_long_runs():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    for t in [*long_texts(), " " * 300 + "a" + " " * 1000, "errer" * 40_000]:
        ids = [i for w, _ in model.encode([t])[0] for i in w]
        assert ids == sp.encode(t), t[:20]
        assert model.decode(ids) == sp.decode(ids), t[:20]


def test_sentencepiece_better_pairs():
    """Words in which a merge often brings about a better pair than its own."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    rnd = random.Random(4)
    parts = "th e r the he in ing an and a aa er re on ion t i n o ti at".split() + ["  ", " ", "    "]
    all_texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 300))) for _ in range(1000)] + ["".join(rnd.choices("etaoinshr", k=3000)) for _ in range(50)]
    for t, words in zip(all_texts, model.encode(all_texts), strict=True):
        assert [i for w, _ in words for i in w] == sp.encode(t), t
