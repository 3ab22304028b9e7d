"""Approximate nearest neighbours by collision counting over query-centred windows (Gan et al., 2012; Huang et al., 2015).

Largest inner product becomes smallest distance. Vectors are dealt by norm: a class holds norms within a fifth of each other, and is
dealt into blocks of bounded size. In a block each vector is divided by M, the largest norm there, and gets one more component,
sqrt(1 - |x|**2); a query has norm 1 and gets 0. So a block's distances are as sharp as its own norms allow, whatever others are.
Each block indexes all its rows with arrays sorted by one projection each. The projections are whole orthonormal bases, drawn at
random: together they keep distances better than independent ones. A query's window in every array is centred on its own projection
and grows by virtual rehashing: the radius is multiplied, and only what the wider window adds is counted. (What windows leave out is
counted, which is less than what they hold: a vector with at most so many misses has the collisions.) Only vectors that reach the
collision threshold are verified by the exact measure. Blocks of queries meet every block of vectors; the k best of each are merged.

About PILOT of the longest vectors (of each length; by a hash among those of one class) are verified for every query. The k-th best of
them is a bound: a block whose M cannot reach it is skipped, and a query is done in a block when the k-th verified distance there, or
the bound's, is within the radius, or the windows hold all.

Only the first radius is fitted, on a sample of at most SAMPLE rows of a block; every row is indexed, and nothing is capped.
Work: a query counts about a quarter of every array of every block that is not skipped, so it grows with the product of queries and
rows; the share of verified rows falls as blocks fill.

Vectors of different lengths have no inner product: those of a length have blocks of their own and meet only each other.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without vec_id take no part; a
repeated query id counts once (its least vector), and no row of the query's own id is found; norms are taken without overflow, and
a product that overflows is infinite (one that is no number comes last); an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, partitions, stored

K = 20
EVERY = 20
PROJECTIONS, COLLISIONS = 128, 0.85  # of the arrays, the share in which a vector must meet a query
HALF_WIDTH = 1.5  # half a window's width in units of the radius: a vector at the radius collides with probability 0.87
GROWTH = 1.05
BLOCK, QUERIES = 16384, 256
SAMPLE = 256
#: Norms of a class lie within a factor of 2 ** (1 / CLASSES).
CLASSES = 4
#: A norm of 1 lies within a class, not between two.
SHIFT = 0.4
PILOT = 128
_HASHES = 1 << 20
_OUT = "query_id long, vec_id long, score double"


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added in their order: the same for equal vectors anywhere."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d].astype(np.float64) * vectors[:, d].astype(np.float64)
    return out


def directions(length: int, least: int = PROJECTIONS) -> np.ndarray:
    """At least `least` lines: random orthonormal bases of the space, scaled so that a difference keeps its length on average."""
    rng = np.random.default_rng(20_240_601)
    made = [np.linalg.qr(rng.standard_normal((length, min(length, least))))[0].T for _ in range(-(-least // length))]
    return np.concatenate(made) * np.sqrt(length)


def norms(x: np.ndarray) -> np.ndarray:
    """Of rows, without overflow or underflow of squares."""
    x = np.abs(x.astype(np.float64))
    most = x.max(1, initial=0.0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(1))


def bounds(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The k-th best inner product of each query of norm 1 with vectors (divided by their largest norm), -inf where they are fewer."""
    scores = queries @ vectors.T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(queries), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


class BlockIndex:
    """The sorted arrays of one block. seeds: rows that every query verifies."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seeds: np.ndarray | None = None, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        self.seeds = np.zeros(len(ids), bool) if seeds is None else seeds
        self.lines = directions(vectors.shape[1] + 1, projections)
        norm = norms(vectors)
        self.most = float(norm.max())
        self.unit = vectors.astype(np.float64) / self.most
        extra = np.sqrt(np.maximum(0.0, 1.0 - (self.unit**2).sum(1)))
        values = self.lines[:, :-1] @ self.unit.T + self.lines[:, -1:] * extra
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, 1)
        self.sample = slice(None, None, -(-len(ids) // SAMPLE))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K, collisions: float = COLLISIONS, least: np.ndarray | None = None):
        """(query row, vector row, score) of the k best found for each query, and how many pairs were verified. least: inner
        products of queries of norm 1 with vectors divided by M below which nothing is wanted."""
        n, nq, m = len(self.ids), len(queries), len(self.lines)
        q = queries.astype(np.float64)
        q = q / norms(q)[:, None]
        at = self.lines[:, :-1] @ q.T
        allowed = m - int(np.ceil(collisions * m))
        least = np.full(nq, -np.inf) if least is None else least
        # distances to a sample: the first radius is a little below the least, or the bound's where that is nearer
        near = 2 - 2 * q @ self.unit[self.sample].T
        radius = np.sqrt(np.maximum(near.min(1), 1e-12)) / GROWTH**3
        enough = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(least, -1.0)))
        radius = np.minimum(radius, np.maximum(enough, 1e-6))
        lo, hi = np.empty((m, nq), np.int64), np.empty((m, nq), np.int64)
        misses: list[np.ndarray | None] = [None] * nq
        found: list[list[np.ndarray]] = [[] for _ in range(nq)]
        products: list[list[np.ndarray]] = [[] for _ in range(nq)]
        kth = np.full(nq, -np.inf)
        seeds = np.flatnonzero(self.seeds)

        def verify(i: int, rows: np.ndarray) -> None:
            rows = rows[self.ids[rows] != query_ids[i]]
            if len(rows):
                found[i].append(rows)
                products[i].append(self.unit[rows] @ q[i])
                known = np.concatenate(products[i])
                if len(known) >= k:
                    kth[i] = np.partition(known, len(known) - k)[len(known) - k]

        for i in range(nq):
            verify(i, seeds)
        open_ = np.flatnonzero(least <= 1 + 1e-9)
        while len(open_):
            reach = radius[open_] * HALF_WIDTH
            ends = np.empty((2, m, len(open_)), np.int64)
            for j in range(m):
                ends[0, j] = np.searchsorted(self.values[j], at[j, open_] - reach, side="left")
                ends[1, j] = np.searchsorted(self.values[j], at[j, open_] + reach, side="right")
            still = np.ones(len(open_), bool)
            for p, i in enumerate(open_.tolist()):
                first, last = ends[0, :, p], ends[1, :, p]
                if misses[i] is None:
                    out = [x[:a] for x, a in zip(self.order, first.tolist(), strict=True)] + [x[b:] for x, b in zip(self.order, last.tolist(), strict=True)]
                    misses[i] = np.bincount(np.concatenate(out), minlength=n)
                    fresh = np.flatnonzero((misses[i] <= allowed) & ~self.seeds)
                else:
                    ring = [x[a:b] for x, a, b in zip(self.order, first.tolist(), lo[:, i].tolist(), strict=True) if a < b]
                    ring += [x[a:b] for x, a, b in zip(self.order, hi[:, i].tolist(), last.tolist(), strict=True) if a < b]
                    gained = np.bincount(np.concatenate(ring), minlength=n) if ring else np.zeros(n, np.int64)
                    fresh = np.flatnonzero((misses[i] > allowed) & (misses[i] - gained <= allowed) & ~self.seeds)
                    misses[i] -= gained
                lo[:, i], hi[:, i] = first, last
                verify(i, fresh)
                distance = np.sqrt(max(0.0, 2 - 2 * max(kth[i], least[i])))
                # the root of a difference of nearly equal numbers is good to 1e-7 only
                if distance <= radius[i] + 1e-7 or (first == 0).all() and (last == n).all():
                    still[p] = False
                    misses[i] = None
            radius[open_] *= GROWTH
            open_ = open_[still]
        # a matrix product may round otherwise than the measure: what is near the k-th is measured again, component by component
        verified = sum(len(x) for y in found for x in y)
        qi, vi = [], []
        for i in range(nq):
            if found[i]:
                rows, known = np.concatenate(found[i]), np.concatenate(products[i])
                rows = rows[known >= kth[i] - 1e-6]
                qi.append(np.full(len(rows), i))
                vi.append(rows)
        qi, vi = (np.concatenate(x) if x else np.array([], np.int64) for x in (qi, vi))
        with np.errstate(over="ignore", invalid="ignore"):
            score = exact(queries[qi], self.vectors[vi])
        order = np.lexsort((self.ids[vi], -np.where(np.isnan(score), -np.inf, score), qi))
        rank = np.arange(len(order)) - np.searchsorted(qi[order], qi[order], side="left")
        top = order[rank < k]
        return qi[top], vi[top], score[top], verified


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding) of finite vectors that are not zero, with the class of their norm."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column(1)
        flat = np.abs(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null component is no number
        offsets = np.asarray(vectors.offsets)
        starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        most = np.maximum.reduceat(flat, starts)  # no number if one component is none
        good = np.isfinite(most) & (most > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            norm = most * np.sqrt(np.add.reduceat((flat / np.repeat(most, sizes)) ** 2, starts))
            cls = np.floor(np.log2(norm) * CLASSES + SHIFT)
        keep = pa.array(good)
        cls = pa.array(np.where(good, cls, 0).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, cls], names=["vec_id", "embedding", "class"]).filter(keep)


def _search(kind: str, k: int):
    """Rows (block, slice, asks, ids, vectors, seeds, pilot_ids, pilot) in the order of the first three: the vectors of a block, then
    the blocks of queries that this slice of the work asks it. Vectors are of numbers of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pilot_ids = pilot = None
        for batch in batches:
            for i in range(batch.num_rows):
                asks, ids, vectors, seeds, own, longest = (batch.column(c)[i].as_py() for c in range(2, 8))
                ids = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(vectors, kind).reshape(len(ids), -1)
                if not asks:
                    index = None  # the one before goes first
                    index = BlockIndex(ids, vectors, np.frombuffer(seeds, np.uint8) == 1)
                    pilot_ids = np.frombuffer(own, np.int64)
                    pilot = np.frombuffer(longest, kind).reshape(len(pilot_ids), -1).astype(np.float64)
                    high = float(norms(pilot).max())
                    pilot /= high
                    continue
                q = vectors.astype(np.float64)
                least = bounds(ids, q / norms(q)[:, None], pilot_ids, pilot, k)
                with np.errstate(over="ignore"):
                    least = np.where(least == 0, 0.0, least * min(high / index.most, 1e300)) - 1e-9
                qi, vi, score, _ = index.search(ids, vectors, k, least=least)
                arrays = [pa.array(ids[qi]), pa.array(index.ids[vi]), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def _packed(rows: DataFrame, first: str, blocks: str, total: int, kind: str) -> DataFrame:
    """(block, ids, vectors, seeds, length): rows dealt to `blocks` blocks from `first` on (columns), as binary values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block, ids, vectors, seeds):
            ids, vectors, seeds = np.concatenate(ids), np.concatenate(vectors), np.concatenate(seeds)
            length = pa.array([len(vectors) // len(ids)], pa.int32())
            arrays = [pa.array([block], pa.int32()), *(pa.array([x.tobytes()]) for x in (ids, vectors, seeds)), length]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "vectors", "seeds", "length"])

        now, ids, vectors, seeds = None, [], [], []
        for batch in batches:
            block = np.asarray(batch.column(0))
            flat = np.asarray(batch.column(2).flatten(), kind)
            starts = np.asarray(batch.column(2).offsets)
            starts = starts - starts[0]
            flags = np.asarray(batch.column(3).cast(pa.uint8()))
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if block[a] != now:
                    if ids:
                        yield out(now, ids, vectors, seeds)
                    now, ids, vectors, seeds = int(block[a]), [], [], []
                ids.append(np.asarray(batch.column(1))[a:b])
                vectors.append(flat[starts[a] : starts[b]])
                seeds.append(flags[a:b])
        if ids:
            yield out(now, ids, vectors, seeds)

    block = (F.col(first) + F.pmod(F.xxhash64("vec_id", "embedding"), F.col(blocks))).cast("int")
    dealt = rows.select(block.alias("block"), "vec_id", "embedding", "seed")
    dealt = dealt.repartition(min(total, partitions(rows)), "block").sortWithinPartitions("block", "vec_id")
    return dealt.mapInArrow(lean(run), "block int, ids binary, vectors binary, seeds binary, length int")


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for rows whose vec_id `every` divides."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, array = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(array).alias("embedding"))
    rows = rows.filter("vec_id is not null and size(embedding) > 0").mapInArrow(lean(_classed), f"vec_id long, embedding {array}, class long")
    rows = rows.withColumns({"length": F.size("embedding"), "hash": F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(_HASHES))})
    # classes of norms are some ten thousand at most for each length of vectors
    counts = rows.groupBy("length", "class").agg(F.count("*").alias("n")).collect()
    if not counts:
        empty = embeddings.sparkSession.createDataFrame([], _OUT)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    deals, asks, total, query_total = _dealt(counts, every)
    frame = lambda rows, schema: F.broadcast(embeddings.sparkSession.createDataFrame(rows, schema))
    deals = frame(deals, "length int, class long, first int, blocks int, seed_hash long")
    asks = frame(asks, "length int, query_first int, query_blocks int, first int, blocks int")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("length", "vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.join(asks.select("length", "query_first", "query_blocks"), "length").withColumn("seed", F.lit(False))
    rows = rows.join(deals, ["length", "class"]).withColumn("seed", F.col("hash") < F.col("seed_hash"))
    vectors = stored(_packed(rows, "first", "blocks", total, kind), "vector-blocks")
    queries = stored(_packed(asked, "query_first", "query_blocks", query_total, kind).join(asks, "length"), "query-blocks")
    pilot = rows.filter("seed").withColumns({"first": F.col("length"), "blocks": F.lit(1)})
    pilot = _packed(pilot, "first", "blocks", partitions(rows), kind).select("length", F.col("ids").alias("pilot_ids"), F.col("vectors").alias("pilot"))
    # few blocks are sent to several tasks, which share the queries
    slices = max(1, min(query_total, 2 * embeddings.sparkSession.sparkContext.defaultParallelism // total))
    payload = ["ids", "vectors", "seeds", "pilot_ids", "pilot"]
    each = vectors.join(pilot, "length").select("block", F.explode(F.array(*map(F.lit, range(slices)))).alias("slice"), F.lit(False).alias("asks"), *payload)
    none = [F.lit(b"").alias(c) for c in payload[2:]]
    met = queries.select(
        F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"), (F.col("block") % slices).alias("slice"), F.lit(True).alias("asks"), "ids", "vectors", *none
    )
    met = each.union(met).repartition(max(partitions(rows), total), "block", "slice").sortWithinPartitions("block", "slice", "asks")
    found = met.mapInArrow(lean(_search(kind, k)), _OUT)
    best = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(best), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(counts: list, every: int) -> tuple[list[tuple], list[tuple], int, int]:
    """Blocks of each class (length, class, first, blocks, hashes of seeds), blocks of queries of each length with the blocks they
    meet, and the numbers of both. Seeds are all of the classes of the longest vectors, as long as these are PILOT at most, and a
    share by hash of the next."""
    by_length: dict[int, list] = {}
    for r in sorted(counts, key=lambda r: (r["length"], -r["class"])):
        by_length.setdefault(r["length"], []).append((r["class"], r["n"]))
    deals, asks, total, query_total = [], [], 0, 0
    for length, classes in by_length.items():
        begin, left, n = total, PILOT, sum(c for _, c in classes)
        for cls, count in classes:
            blocks = -(-count // BLOCK)
            share = _HASHES if count <= left else -(-left * _HASHES // count)
            deals.append((length, cls, total, blocks, share))
            left, total = max(0, left - count), total + blocks
        query_blocks = -(-n // (every * QUERIES))
        asks.append((length, query_total, query_blocks, begin, total - begin))
        query_total += query_blocks
    return deals, asks, total, query_total
