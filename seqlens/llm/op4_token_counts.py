"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens). Content and tokenizer-version digests are
joined to it; only distinct misses are encoded, and their counts are appended. Content is normalised before the digest by
what the tokenizer itself ignores: for byte-level BPE nothing, so only null becomes the empty text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; a null doc_id is kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_at_exit, lean, partitions, shared_dir, text_of
from .fastenc import encoder

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Changes with the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _first_seen(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Drops repeats that one partition can see, so that no digest brings more than a few rows of a partition to its task."""
    seen: set = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))
        if len(seen) > most:
            seen.clear()


def fill_cache(docs: DataFrame, cache_path: str, tokenizer_path: str, kind: str = "byte", text: str = "text") -> DataFrame:
    """Append the counts of the texts that the cache at cache_path lacks; returns the cache's rows for this tokenizer."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cache() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version)

    content = text_of(docs, text)
    keyed = docs.select(F.sha2(content, 256).alias("content_digest"), content.alias("text"))
    if not cache().isEmpty():
        keyed = keyed.join(cache(), "content_digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kind)
        for batch in _first_seen(batches, 1 << 62):
            ids = enc.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(ids), pa.string()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=["content_digest", "tokenizer_digest", "n_tokens"],
            )

    distinct = keyed.mapInArrow(lean(_first_seen), "content_digest string, text string").repartition(partitions(docs), "content_digest")
    distinct.mapInArrow(lean(count), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return cache()


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, kind: str = "byte"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. Without cache_path a fresh cache is used."""
    place = cache_path or shared_dir(docs.sparkSession, "token-cache")
    cache = fill_cache(docs, place, tokenizer_path, kind)
    if not cache_path:
        drop_at_exit(docs.sparkSession, place)
    content = text_of(docs)
    rows = docs.select("doc_id", F.sha2(content, 256).alias("content_digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    # two writers may have appended the same digest: one count for each
    counts = cache.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
