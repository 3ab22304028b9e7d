"""Token ids as files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents (ascending doc_id, ties by the text's digest, null first): shards of a range of
doc_ids follow each other, each of SHARD ids or the last document's more. Its payload:

    header   magic "PFR1", block size (u32), number of ids (u64), number of blocks (u32)
    index    for each block: start of its packed bits in the payload (u64)
    blocks   minimum (u32), width (u8), exceptions (u16), packed bits, exception places (u16), exception high parts (u32)

In a block the minimum is subtracted; the width is that of the given percentile of the rest; the low bits of all values are
packed at that width, and what exceeds them goes to the exception list. Documents of the shard (doc_id, number of ids) are
stored beside the payload. Shards are rows of a Parquet table, so that Spark's committer writes them to any store, once.

Defined results: null and empty texts hold the end id alone; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_at_exit, lean, partitions, range_bounds, shared_dir, text_of
from .fastenc import encoder

BLOCK = 8192
PERCENTILE = 90
SHARD = 1 << 21
_HEAD = struct.Struct("<4sIQI")
SHARD_SCHEMA = "range long, first long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def _widths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    """Low `width` bits of unsigned 32-bit values, highest bit first."""
    word = 16 if width <= 16 else 32
    raw = values.astype(f">u{word // 8}").view(np.uint8).reshape(-1, word // 8)
    return np.packbits(np.unpackbits(raw, axis=1)[:, word - width :]).tobytes()


def _unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    word = 16 if width <= 16 else 32
    out = np.zeros((n, word), np.uint8)
    out[:, word - width :] = np.unpackbits(data, count=n * width).reshape(n, width)
    return np.packbits(out, axis=1).view(f">u{word // 8}").ravel().astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    ids = ids.astype(np.uint32)
    starts, parts, at = [], [], 0
    n = len(ids)
    blocks = -(-n // block)
    at = _HEAD.size + 8 * blocks
    for b in range(blocks):
        x = ids[b * block : (b + 1) * block]
        low = x.min()
        x = x - low
        width = int(_widths(np.partition(x, k := min(len(x) - 1, len(x) * percentile // 100))[k : k + 1])[0])
        over = np.flatnonzero(x >> np.uint32(width)) if width < 32 else np.array([], np.int64)
        data = (
            struct.pack("<IBH", int(low), width, len(over))
            + (_pack_bits(x, width) if width else b"")
            + over.astype("<u2").tobytes()
            + (x[over] >> np.uint32(width)).astype("<u4").tobytes()
        )
        starts.append(at)
        parts.append(data)
        at += len(data)
    return _HEAD.pack(b"PFR1", block, n, blocks) + np.array(starts, "<u8").tobytes() + b"".join(parts)


def decode_blocks(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default); the index leads straight to them."""
    magic, block, n, blocks = _HEAD.unpack_from(payload)
    if magic != b"PFR1":
        raise ValueError("not a token file")
    last = blocks if last is None else min(last, blocks)
    starts = np.frombuffer(payload, "<u8", blocks, _HEAD.size)
    out = []
    for b in range(first, last):
        m = min(block, n - b * block)
        at = int(starts[b])
        low, width, over = struct.unpack_from("<IBH", payload, at)
        at += 7
        size = (m * width + 7) // 8
        x = _unpack_bits(np.frombuffer(payload, np.uint8, size, at), m, width) if width else np.zeros(m, np.uint32)
        at += size
        place = np.frombuffer(payload, "<u2", over, at)
        x[place] |= np.frombuffer(payload, "<u4", over, at + 2 * over) << np.uint32(width)
        out.append(x + np.uint32(low))
    return np.concatenate(out) if out else np.array([], np.uint32)


def token_bound(tokenizer_path: str) -> int:
    """Above every id of a tokenizer file."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *[x["id"] for x in spec["added_tokens"]]])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, kind: str, end_id: int, docs_per_range: int = 2048, most: int = SHARD) -> None:
    """Shards of documents in ascending doc_id at path."""
    bounds = range_bounds(docs, "doc_id", docs_per_range)
    short = max(token_bound(tokenizer_path), end_id + 1) <= 1 << 16  # then ids travel in two bytes each
    kind_of_id = "<u2" if short else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kind)
        for batch in batches:
            ids = [np.append(np.frombuffer(x, "<u4"), end_id).astype(kind_of_id).tobytes() for x in enc.encode(batch.column(1).to_pylist())]
            doc = batch.column(0)
            of = np.searchsorted(bounds, np.array(doc.fill_null(np.iinfo(np.int64).min)), side="left")
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), doc, batch.column(2), pa.array(ids, pa.binary())], names=["range", "doc_id", "tie", "ids"]
            )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, size, doc_ids, parts = None, 0, 0, [], []

        def done() -> pa.RecordBatch:
            payload = encode_blocks(np.frombuffer(b"".join(parts), kind_of_id))
            lengths = [len(p) // np.dtype(kind_of_id).itemsize for p in parts]
            row = [[now], [first], [size], [doc_ids], [lengths], [payload]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["range", "first", "n_ids", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for of, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if of != now or size >= most:
                    if parts:
                        yield done()
                    now, first, size, doc_ids, parts = of, (first + size if of == now else 0), 0, [], []
                doc_ids.append(doc)
                parts.append(ids)
                size += len(ids) // np.dtype(kind_of_id).itemsize
        if parts:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text"), F.md5(text_of(docs)).alias("tie"))
    encoded = rows.mapInArrow(lean(encode), "range long, doc_id long, tie string, ids binary")
    # a range's number says where it lies in the order, so a plain exchange does and no range sample reads texts twice
    dealt = encoded.repartition(partitions(docs), "range").sortWithinPartitions("range", "doc_id", "tie").select("range", "doc_id", "ids")
    dealt.mapInArrow(lean(shards), SHARD_SCHEMA).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, first, doc_ids, lengths, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                data = memoryview(decode_blocks(payload).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [[of] * len(doc_ids), doc_ids, first + starts, lengths, crc]
                names = ["range", "doc_id", "own_start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    rows = files.select("range", "first", "doc_ids", "lengths", "payload").mapInArrow(
        decode, "range long, doc_id long, own_start long, n_tokens long, ids_crc32 long"
    )
    # at most MAX_BUCKETS ranges, whatever the number of documents
    sizes = sorted((r["range"], r["n"]) for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())
    bases = list(zip([k for k, _ in sizes], [0, *accumulate(n for _, n in sizes)], strict=False))
    base = F.broadcast(spark.createDataFrame(bases, "range long, base long"))
    return rows.join(base, "range").select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, kind: str = "word", end_id: int = 2, path: str | None = None) -> DataFrame:
    place = path or shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, place, tokenizer_path, kind, end_id)
    if not path:
        drop_at_exit(docs.sparkSession, place)
    return read_token_files(docs.sparkSession, place)
