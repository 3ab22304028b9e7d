"""Phrases against a brute-force version, at several sizes of the bit table and of windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.llm import op11_phrases as op

SCHEMA = "doc_id long, lang string, text string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, most, share=80, longest=4):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {g: n for g, n in counts.items() if n >= least}
    out = []
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        held = any(
            of == lang and len(x) > len(w) and 100 * n >= share * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for (of, x), n in often.items()
        )
        if not held:
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for lang, phrase, a, left, right, n, score in out:
        seen[lang] += 1
        if seen[lang] <= most:
            ranked.append((lang, seen[lang], phrase, a, left, right, n, score))
    return ranked


def rows_of(seed=3):
    rng = random.Random(seed)
    words = ["a", "B", "b", "c", "é", "É", "\U0001f600", "x-y", "\x01", "zz", "\xa0", "ab"]
    rows = []
    for _ in range(300):
        parts = [rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "de", None]), "".join(parts)))
    rows += [("en", "New York City Hall. " * 12), ("en", "new york"), ("en", None), ("de", ""), ("und", "a b a b"), ("", "a b " * 9), ("en", "a a a a a a a a")]
    return rows


def found(df, **how):
    return [tuple(r) for r in op.phrases(df, **how).select(*COLUMNS).orderBy(F.col("lang"), F.col("rank")).collect()]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("most", [2000, 5])
def test_against_brute_force(spark, most):
    rows = rows_of()
    want = brute(rows, 5, most)
    assert len(want) > 10
    assert found(frame(spark, rows), least=5, most=most) == sorted(want, key=lambda r: (r[0].encode(), r[1]))


def test_a_full_bit_table_and_small_windows_change_nothing(spark, monkeypatch):
    rows = rows_of(4)
    code = op._counter

    def small(k, table=None):
        inner = code(k, table)

        def run(batches):
            op.WINDOW = 40  # in the worker

            yield from inner(batches)

        return run

    monkeypatch.setattr(op, "BITS", 64)
    monkeypatch.setattr(op, "_counter", small)
    assert found(frame(spark, rows), least=5) == sorted(brute(rows, 5, 2000), key=lambda r: (r[0].encode(), r[1]))


def test_windows_keep_pieces_whole(monkeypatch):
    monkeypatch.setattr(op, "WINDOW", 10)
    texts = [b"abc def, ghi", b"", b"one very long piece without an end", b"x. y. z. " * 4]
    got = b"".join(w[0].tobytes() for w in op.windows(texts, ["en"] * 4))
    assert [p for p in re.split(rb"[.,\n]", got) if p] == [p for t in texts for p in re.split(rb"[.,\n]", t) if p]


def test_distinct_rows_of_wide_columns():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500) * 10**9, rng.integers(0, 3, 500) * 10**9, rng.integers(0, 3, 500), rng.integers(0, 3, 500) * 10**8]
    out, n = op._distinct(columns)
    assert Counter(zip(*(c.tolist() for c in columns), strict=True)) == dict(zip(zip(*(c.tolist() for c in out), strict=True), n.tolist(), strict=True))


def test_products_past_64_bits(spark):
    big = 9_000_000_000_000_000_000
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big)], op.COUNTS)
    two = spark.createDataFrame([("en", "a b", big - 1)], op.COUNTS)
    row = op.scored([one, two, two.limit(0), two.limit(0)]).first()
    assert (row.score, row.l, row.r) == (2_000_000 * (big - 1) // (2 * big), big, big)
    assert op.outermost(op.scored([one, two])).count() == 1


def test_empty_table_and_clashing_names(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = rows_of()[:120]
    df = frame(spark, rows)
    for name in ("phrase", "n", "rank", "a", "size", "score", "place", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    assert found(df, least=5) == sorted(brute(rows, 5, 2000), key=lambda r: (r[0].encode(), r[1]))


def test_a_very_long_text(spark):
    rows = [("en", "to be or not to be " * 100_000)]
    assert found(frame(spark, rows, 1)) == brute(rows, 30, 2000)
