"""Shortest-pack-first packing over the length histogram.

A document's ids (and an end id) are cut into full pieces of the sequence length and one rest. Lengths of pieces are
counted; on the driver, which sees only that histogram of at most `size` numbers, lengths are placed longest first, each
into the pattern with the most room, updating how many packs have a pattern. Patterns are joined back to pieces by their
rank within their length.

Ranks need no task that holds all pieces of a length: pieces are dealt into buckets by a hash, ranked there, and moved
by the counts of the buckets before.

Defined results: null and empty texts hold the end id alone; repeated rows are packed each; an empty table gives no rows;
a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored, text_of
from .fastenc import encoder

SIZE = 1024
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = SIZE, kind: str = "byte") -> DataFrame:
    """Pieces of at most `size` ids of every document, with the crc32 of their ids."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kind)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, size):
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).mapInArrow(lean(run), PIECE_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns (lengths in their order, number of packs) for counts of lengths. A length splits at most one pattern and
    opens at most two, so there are at most three patterns a length."""
    shortest: list[tuple[int, int]] = []  # (filled, pattern), a heap: the emptiest packs first
    patterns: list[list] = []

    def opened(lengths: list[int], count: int) -> None:
        patterns.append([lengths, count])
        heapq.heappush(shortest, (sum(lengths), len(patterns) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and shortest and shortest[0][0] + length <= size:
            _, k = heapq.heappop(shortest)
            lengths, count = patterns[k]
            take = min(count, left)
            patterns[k] = [[*lengths, length], take]
            heapq.heappush(shortest, (sum(lengths) + length, k))
            if take < count:
                opened(lengths, count - take)
            left -= take
        each = size // length
        if left >= each:
            opened([length] * each, left // each)
        if left % each:
            opened([length] * (left % each), 1)
    return [(lengths, count) for lengths, count in patterns]


def _slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of every place of every pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            out.append((length, rank, rank + count, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = SIZE, kind: str = "byte") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, size, kind), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots = _slots(shortest_pack_first(histogram, size))
    table = spark.createDataFrame(slots, "s_length long, lo long, hi long, first_sequence long, offset long")

    deals = max(16, sum(histogram.values()) // 50_000)
    keyed = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(deals)))
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "deal").agg(F.count("*").alias("n"))
    bases = counts.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (
        keyed.withColumn("own", F.row_number().over(within) - 1)
        .join(bases, ["length", "deal"])
        .withColumn("rank", F.col("base") + F.col("own"))
    )
    # at most a few places for each of `size` lengths: bounded whatever the input
    hit = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(table), hit).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )
