"""Threshold-scaled document fingerprints.

A fingerprint keeps every shingle hash (five words) below a fixed fraction of the hash range, whatever the document's
length: sketches of parts merge by union, and containment between very unequal documents can be estimated from them.

Text form: "f<bits>:<digest of the text>:<kept hashes>", 8 hexadecimal digits a hash in ascending order, where the
fraction is 2**-bits. The digest tells apart short texts of which no hash was kept.

Defined results: null and empty texts have no kept hash; likeness is 1 if the digests are equal, otherwise the Jaccard
index of the kept hashes, 0 if neither keeps any. The next document is that of the next smaller doc_id (null is smallest);
equal ids are ordered by text; the document after the last is the first, so a lone document is followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, range_bounds, text_of
from .textvec import groups_of, shingle_hashes

BITS = 2
LOWEST = -(2**63)
OUT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def sketches(texts: list[str], bits: int = BITS, width: int = 5) -> list[tuple[str, np.ndarray]]:
    """(digest, kept hashes as ascending unsigned 32-bit numbers) of each text."""
    out = []
    for part in groups_of(texts):
        hashes, ends = shingle_hashes(part, width)
        kept = np.flatnonzero(hashes < np.uint64(1 << (64 - bits)))
        small = (hashes[kept] >> np.uint64(32 - bits)).astype(np.uint32)
        stops = np.searchsorted(kept, ends)
        at = 0
        for text, stop in zip(part, stops.tolist(), strict=True):
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            out.append((digest, np.unique(small[at:stop])))
            at = stop
    return out


def to_text(sketch: tuple[str, np.ndarray], bits: int = BITS) -> str:
    return f"f{bits}:{sketch[0]}:{sketch[1].astype('>u4').tobytes().hex()}"


def from_text(fingerprint: str) -> tuple[str, np.ndarray]:
    _, digest, kept = fingerprint.split(":")
    return digest, np.frombuffer(bytes.fromhex(kept), ">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kept hashes of the union of two documents' shingles."""
    return np.union1d(a, b)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 0 if a keeps none."""
    return _shared(a, b) / len(a) if len(a) else 0.0


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    if a[0] == b[0]:
        return 1.0
    both = _shared(a[1], b[1])
    return both / (len(a[1]) + len(b[1]) - both) if both else 0.0


def fingerprints(docs: DataFrame, bits: int = BITS, docs_per_bucket: int = 1024) -> DataFrame:
    """One exchange deals documents into buckets of consecutive ids; the first of each goes to the bucket before as well."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    bounds = range_bounds(rows, "key", docs_per_bucket)

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, keys, side="left")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for b, k in zip(bucket_of(keys).tolist(), keys.tolist(), strict=True):
                most[b] = max(k, most.get(b, k))
        yield pa.RecordBatch.from_arrays([pa.array(most.keys(), pa.int64()), pa.array(most.values(), pa.int64())], names=["bucket", "key"])

    # one number a bucket reaches the driver, and buckets are bounded in number
    found = rows.select("key").mapInArrow(lean(heads), "bucket long, key long").groupBy("bucket").agg(F.max("key").alias("key")).collect()
    order = sorted((r.bucket, r.key) for r in found)
    to = {k: order[(i + 1) % len(order)][0] for i, (_, k) in enumerate(order)}
    first_keys = np.array(sorted(to), dtype=np.int64)
    first_to = np.array([to[k] for k in sorted(to)], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            if not len(keys):
                continue
            place = np.minimum(np.searchsorted(first_keys, keys), len(first_keys) - 1)
            again = np.flatnonzero(first_keys[place] == keys)
            take = pa.array(np.concatenate([np.arange(len(keys)), again]))
            bucket = np.concatenate([bucket_of(keys), first_to[place[again]]])
            copy = np.concatenate([np.zeros(len(keys), np.int32), np.ones(len(again), np.int32)])
            cols = [pa.array(bucket, pa.int64()), pa.array(copy), *(batch.column(i).take(take) for i in range(3))]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "copy", "key", "doc_id", "text"])

    def finish(held: list[tuple], last: bool) -> tuple[pa.RecordBatch | None, list[tuple]]:
        """held: (bucket, copy, doc_id, text) in order. The last row waits for the one after it."""
        if not held or (len(held) < 2 and not last):
            return None, held
        texts = [r[3] for r in held]
        own = sketches(texts, bits)
        mine = [i for i in range(len(held) - 1) if not held[i][1]]
        edits = []
        for i in mine:
            n = len(texts[i])
            edits.append(texts[i][: n - n // 2] + texts[i + 1][: n // 2])
        other = sketches(edits, bits)
        cols = [
            [held[i][2] for i in mine],
            [len(texts[i]) for i in mine],
            [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
            [to_text(own[i], bits) for i in mine],
            [to_text(s, bits) for s in other],
            [likeness(own[i], s) for i, s in zip(mine, other, strict=True)],
            [likeness(own[i], own[i + 1]) for i in mine],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in OUT_SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        return out, ([] if last else held[-1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][1] and row[1] and held[-1][0] == row[0]:
                    continue  # more rows of the id that begins the next bucket: only the first of them follows
                held.append(row)
                size += len(row[3])
                if size > 8_000_000:
                    out, held = finish(held, False)
                    size = sum(len(r[3]) for r in held)
                    if out is not None:
                        yield out
        out, _ = finish(held, True)
        if out is not None:
            yield out

    dealt = rows.mapInArrow(lean(deal), "bucket long, copy int, key long, doc_id long, text string")
    in_order = dealt.repartition(partitions(docs), "bucket").sortWithinPartitions("bucket", "copy", F.desc("key"), "text")
    return in_order.select("bucket", "copy", "doc_id", "text").mapInArrow(lean(run), OUT_SCHEMA)
