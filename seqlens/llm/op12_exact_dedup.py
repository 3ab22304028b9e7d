"""Exact dedup by skew-safe combining, with DataFrame functions alone.

Texts are equal when they are identical without the characters of `[\\x20\\x09-\\x0D]`. Equal texts are combined in three stages,
each of which groups by the digest and the whole normalised text, so that the digest never decides alone:

1. every task combines the rows it reads (partial aggregation, before anything is shuffled);
2. groups of (digest, salt, text) combine what the tasks left; the salt is that of the task, so a text that is everywhere meets in
   as many groups as there are salts, not in one;
3. the winners of the salts are dealt by digest and combine globally: a row a salt and text at most.

What stays of a group is the largest of one number made of length and id. Rows then learn their group by digest: groups of over a
thousandth of all rows number less than a thousand, so these are broadcast and their rows stay where they are; the others are
joined. A digest of several texts (a collision) is known from stage 3, and its rows are combined once more by text instead.

Defined results: a null text is empty; all empty and blank texts are equal; of equal texts the row of most code points stays, then
the one of the least id, a null id last; rows that tie in all of these are the same row and are marked alike; an empty table
gives no rows; ids are integers; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, text_of

#: Fixed value: the characters that do not count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: A group of more than one in so many rows is broadcast; there are fewer than that many.
SHARE = 1000
#: A length counts so much more than any id.
_STEP = 1 << 65
_HIGH = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def _rank() -> Column:
    """One number that is largest for the row that stays: most code points, then least id, then no id."""
    whole = lambda v, digits: v.cast(f"decimal({digits},0)")
    place = F.coalesce(whole(F.lit(_HIGH), 19) + F.lit(1) - whole(F.col("id"), 19), F.lit(0))
    return whole(whole(F.col("n"), 12) * whole(F.lit(str(_STEP)), 21) + whole(place, 21), 38)


def _with_winner(groups: DataFrame) -> DataFrame:
    """best as keep_id and keep_n."""
    place = f"pmod(best, cast('{_STEP}' as decimal(38,0)))"
    return groups.withColumns({
        "keep_id": F.expr(f"case when {place} > 0 then cast(cast('{_HIGH + 1}' as decimal(38,0)) - {place} as bigint) end"),
        "keep_n": F.expr(f"best div cast('{_STEP}' as decimal(38,0))"),
    }).drop("best")


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combine(rows: DataFrame) -> DataFrame:
    """(digest, text, best, size): rows (id, n, digest, text) combined by each task, by salt and over all."""
    salt = F.pmod(F.spark_partition_id(), F.lit(partitions(rows)))
    merged = rows.withColumn("salt", salt).groupBy("digest", "salt", "text").agg(F.max(_rank()).alias("best"), F.count("*").alias("size"))
    winners = merged.select("digest", "text", "best", "size").repartition("digest").groupBy("digest", "text")
    return winners.agg(F.max("best").alias("best"), F.sum("size").alias("size"))


def groups_of_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id", digest_of: Callable[[Column], Column] = _sha256) -> DataFrame:
    """For each row its id, digest and n_chars, and of its group keep_id, group_size, kept. digest_of maps a normalised text to
    bytes; texts that it confuses are told apart."""
    whole = text_of(docs, text)
    clean = normalised(whole)
    rows = docs.select(
        docs[row_id].cast("bigint").alias("id"), F.char_length(whole).cast("bigint").alias("n"), digest_of(clean).alias("digest"), clean.alias("text")
    )
    texts = combine(rows)
    by_digest = texts.groupBy("digest").agg(F.max("best").alias("best"), F.sum("size").alias("size"), F.count("*").alias("texts"))
    groups = stored(_with_winner(by_digest), "copies")
    found = _members(rows.select("id", "n", "digest"), groups)
    confused = groups.filter("texts > 1").select("digest")
    if not confused.isEmpty():
        some = rows.join(confused, "digest", "left_semi")
        apart = _with_winner(combine(some))
        found = found.join(confused, "digest", "left_anti").unionByName(some.join(apart, ["digest", "text"]).drop("text"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return found.select("id", "digest", F.col("n").alias("n_chars"), "keep_id", F.col("size").alias("group_size"), kept.alias("kept"))


def _members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their group's keep_id, keep_n and size, by digest."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    own = groups.select("digest", "size", "keep_id", "keep_n")
    large = own.filter(F.col("size") * SHARE > total)  # fewer than SHARE rows
    rows = rows.join(F.broadcast(large), "digest", "left")
    # rows that are settled are dealt by their id, which is shorter than a digest
    key = F.when(F.col("size").isNull(), F.col("digest")).otherwise(F.coalesce(F.col("id").cast("string"), F.lit("-")).cast("binary"))
    other = own.filter(F.col("size") * SHARE <= total).toDF("key", "size2", "keep_id2", "keep_n2")
    rows = rows.withColumn("key", key).join(other, "key", "left")
    known = F.col("size").isNotNull()
    pick = {c: F.when(known, F.col(c)).otherwise(F.col(f"{c}2")) for c in ("keep_id", "keep_n", "size")}
    return rows.select("id", "n", "digest", *[c.alias(name) for name, c in pick.items()])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) for every row."""
    found = groups_of_copies(docs)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
