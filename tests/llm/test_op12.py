"""Exact dedup against a brute-force version: ties, nulls, hot groups, confused digests, clashing names."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqlens.llm import op12_exact_dedup as op

BLANKS = str.maketrans("", "", op.BLANKS)
SCHEMA = "doc_id long, text string"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row."""
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(BLANKS), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        x = (t or "").translate(BLANKS)
        most, _, keep = min(groups[x], key=lambda r: (r[0], r[1], r[2] or 0))
        out.append((i, keep, len(groups[x]), i == keep and -len(t or "") == most, hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def cases():
    rng = random.Random(5)
    words = ["a", "b", "é", "\U0001f600", " ", " x"]
    rows = [(i, rng.choice(["", " ", "\n\t"]).join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(400)]
    rows += [(1000 + i, "hot text" + " " * (i % 7)) for i in range(300)]
    return rows + [(2000, None), (2001, ""), (2002, " \x0b\x0c\r"), (None, "b a"), (None, None), (7, rows[7][1]), (-5, "q"), (-(1 << 63), "q"), ((1 << 63) - 1, "q")]


def test_against_brute_force(spark):
    rows = cases()
    assert found(op.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_only_groups_without_a_thousandth_of_the_rows(spark, monkeypatch):
    rows = cases()
    monkeypatch.setattr(op, "SHARE", 0)  # nothing is broadcast
    assert found(op.exact_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("weak", [lambda t: F.lit(b"x"), lambda t: F.substring(t, 1, 1).cast("binary")])
def test_confused_digests_are_told_apart(spark, weak):
    rows = cases()
    got = op.groups_of_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), digest_of=weak)
    want = [r[:4] for r in brute(rows)]
    assert sorted((tuple(r) for r in got.select("id", "keep_id", "group_size", "kept").collect()), key=repr) == sorted(want, key=repr)


def test_empty_table_and_clashing_names(spark):
    assert found(op.exact_duplicates(spark.createDataFrame([], SCHEMA))) == []
    rows = cases()[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "salt", "best", "size", "keep_id", "n", "id", "key", "size2", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    assert found(op.exact_duplicates(df)) == brute(rows)


def test_a_very_long_text_and_repeats_of_it(spark):
    rows = [(1, "long " * 400_000), (2, "long" * 400_000), (3, "long " * 400_000)]
    assert found(op.exact_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_no_python_in_the_plan(spark):
    plan = op.exact_duplicates(spark.createDataFrame([(1, "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
