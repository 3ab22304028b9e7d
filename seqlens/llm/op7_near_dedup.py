"""Near-duplicate documents by DartMinHash (Christiani, 2020) signatures and banded joining.

A text is the multiset of its shingles (five words); likeness is the weighted Jaccard index of the counts. Hashed darts
are thrown into the regions (weight, rank) of each element; a dart that falls under the element's weight and below the
rank bound is kept, and each signature coordinate keeps the earliest dart of those hashed to it. Rank bounds shrink with a
text's total weight, so every text keeps about the same number of darts; a text with an empty coordinate doubles its bound.

Steps: texts are grouped by digest into classes; bands of the signatures of classes are joined; in each band every class is
compared with the band's centre (a star, never all pairs) by the exact likeness of the texts; components of the links follow.
Bands that still hold several components are searched for the remaining links: blocks of bounded size, holding the shingles
of their classes, compare classes of different components exactly and return only links that join components.

Defined results: null counts as empty text; a text without words joins only equal texts; repeated rows and copies share a
group, of which one row is kept; a group's id is its smallest doc_id (null only if all are null); an empty table gives no rows;
columns of any name go along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, lean, partitions, row_of, stored, text_of
from .components import connected_components, join_components
from .textvec import U, groups_of, mix, shingle_hashes

BANDS, ROWS = 20, 4
COORDS = BANDS * ROWS
THRESHOLD = 0.8
BLOCK = 2000
_MULT = U(0x9E3779B97F4A7C15)
#: Distribution function of the Poisson law with mean 1.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 12)])))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def darts(ids: np.ndarray, weights: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, rank, dart) of all darts of elements `ids` under their weights and below their rank bounds.

    Region (n, p) spans weights [2**n - 1, 2**(n+1) - 1) and ranks [2**p - 1, 2**(p+1) - 1). It is cut into 2**p stripes of
    weight and 2**n of rank, so each cell has area 1 and a Poisson number of darts, the same for every text."""
    found = []
    if not len(ids):
        return np.array([], np.int64), np.array([]), np.array([], np.uint64)
    for n in range(int(np.log2(1 + weights.max())) + 1):
        low = 2.0**n - 1
        heavy = np.flatnonzero(weights > low)
        for p in range(int(np.log2(1 + bound[heavy].max(initial=0))) + 1):
            base = 2.0**p - 1
            el = heavy[bound[heavy] > base]
            if not len(el):
                continue
            wide, tall = 2.0**n / 2.0**p, 2.0**p / 2.0**n
            stripes = min(2**p, int(np.ceil((weights[el].max() - low) / wide)))
            rows = min(2**n, int(np.ceil((bound[el].max() - base) / tall)))
            w = np.tile(np.repeat(np.arange(stripes), rows), len(el))
            r = np.tile(np.arange(rows), len(el) * stripes)
            e = np.repeat(el, stripes * rows)
            in_reach = (weights[e] > low + w * wide) & (bound[e] > base + r * tall)
            e, w, r = e[in_reach], w[in_reach], r[in_reach]
            tag = mix(np.array([(n << 32) | p], np.uint64) * _MULT + U(1))[0]
            cell = mix(ids[e] ^ (tag + ((r << 24) + w + 1).astype(np.uint64) * _MULT))
            count = np.searchsorted(_POISSON, _unit(cell), side="right")
            for k in range(int(count.max(initial=0))):
                on = np.flatnonzero(count > k)
                x = mix(cell[on] + U((2 * k + 1) * int(_MULT) % 2**64))
                y = mix(x + _MULT)
                at = base + (r[on] + _unit(y)) * tall
                ok = (low + (w[on] + _unit(x)) * wide < weights[e[on]]) & (at < bound[e[on]])
                found.append((e[on[ok]], at[ok], mix(y + _MULT)[ok]))
    if not found:
        return np.array([], np.int64), np.array([]), np.array([], np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(ids: np.ndarray, weights: np.ndarray, ends: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """A row of `coords` unsigned 32-bit numbers for each set of weighted elements; zeros for an empty set."""
    sets = len(ends)
    out = np.zeros((sets, coords), np.uint32)
    begins = np.concatenate([[0], ends[:-1]]) if sets else ends
    sizes = ends - begins
    owner = np.repeat(np.arange(sets), sizes)
    total = np.bincount(owner, weights, sets) if len(ids) else np.zeros(sets)
    want = coords * np.log(coords) + 2 * coords
    todo = np.flatnonzero(sizes)
    scale = 1.0
    while len(todo):
        own = np.isin(owner, todo) if len(todo) < sets else np.ones(len(owner), bool)
        where = np.flatnonzero(own)
        o = owner[where]
        el, rank, dart = darts(ids[where], weights[where], scale * want / total[o])
        key = o[el] * coords + (dart % U(coords)).astype(np.int64)
        least = np.full(sets * coords, np.inf)
        np.minimum.at(least, key, rank)
        first = rank == least[key]
        sig = np.zeros(sets * coords, np.uint32)
        sig[key[first]] = (dart[first] >> U(32)).astype(np.uint32)
        full = np.isfinite(least.reshape(sets, coords)).all(1)
        done = todo[full[todo]]
        out[done] = sig.reshape(sets, coords)[done]
        todo = todo[~full[todo]]
        scale *= 2
    return out


def weighted_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (ascending), their counts, and the end of each text's among them."""
    hashes, stops = shingle_hashes(texts)
    ids, counts, ends, at, n = [], [], [], 0, 0
    for stop in stops.tolist():
        h, c = np.unique(hashes[at:stop], return_counts=True)
        ids.append(h)
        counts.append(c)
        n += len(h)
        ends.append(n)
        at = stop
    return np.concatenate(ids), np.concatenate(counts).astype(np.float64), np.array(ends, np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two (ids, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 0.0


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a digest from a partition: copies do not pile up at one task."""
    seen: set = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _first_seen(batches):
        sigs = []
        for part in groups_of(batch.column(1).to_pylist(), 1_000_000):
            sigs += [s.tobytes() if s.any() else None for s in signatures(*weighted_sets(part))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], names=["digest", "sig"])


def _band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    x = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT, x.shape[:2])
    for r in range(ROWS):
        key = mix(key ^ (x[:, :, r] + _MULT))
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
            digests = batch.column(0).take(pa.array(np.repeat(np.arange(len(sigs)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(_band_keys(sigs).ravel()), digests], names=["band", "digest"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text) -> (digest, ids, counts): the weighted shingles of a text."""
    for batch in batches:
        digests, at = batch.column(0).to_pylist(), 0
        for part in groups_of(batch.column(1).to_pylist(), 1_000_000):
            ids, counts, ends = weighted_sets(part)
            begins = np.concatenate([[0], ends[:-1]]).tolist()
            spans = list(zip(begins, ends.tolist(), strict=True))
            cols = [[x[a:b].tobytes() for a, b in spans] for x in (ids, counts.astype(np.uint32))]
            arrays = [pa.array(c, pa.binary()) for c in (digests[at : at + len(part)], *cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "ids", "counts"])
            at += len(part)


def _set(ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, part, digest, sig) sorted by (band, part): each class with the centre of its part of a band, which is the
    class that agrees most with the part's commonest value in each coordinate. (band, part, a: centre, b: class)"""

    def out(band: int, part: int, digests: list[bytes], sigs: list[bytes]) -> pa.RecordBatch:
        s = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDS)
        if len(s) > 2:
            order = np.sort(s, axis=0)
            agree = np.zeros(len(s))
            for j in range(COORDS):
                values, counts = np.unique(order[:, j], return_counts=True)
                agree += s[:, j] == values[counts.argmax()]
            k = int(agree.argmax())
        else:
            k = 0
        n = len(digests)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        cols = [[band] * n, [part] * n, [digests[k]] * n, digests]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["band", "part", "a", "b"])

    now, held = None, ([], [])
    for batch in batches:
        for band, part, digest, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (band, part) != now:
                if now:
                    yield out(*now, *held)
                now, held = (band, part), ([], [])
            held[0].append(digest)
            held[1].append(sig)
    if now:
        yield out(*now, *held)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, ids, counts) sorted by (a, part, b is not null): the set of a, then those of the classes b to compare."""
    now, own = None, None
    for batch in batches:
        left, right, like = [], [], []
        for a, part, b, ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b is None:
                now, own = (a, part), _set(ids, counts)
            elif now == (a, part):
                x = likeness(own, _set(ids, counts))
                if x >= THRESHOLD:
                    left.append(a)
                    right.append(b)
                    like.append(x)
        if left:
            arrays = [pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(like)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "likeness"])


def block_links(digests: list, roots: list, chunk: np.ndarray, sets: list, across: bool) -> list[tuple[bytes, bytes, float]]:
    """Links that join the components `roots` of a block: all pairs of different components that the threshold's bound on the
    totals allows are compared exactly, through the block's inverted lists; of the links found, a spanning forest is kept."""
    names, number = np.unique(np.array(roots, object), return_inverse=True)
    if len(names) < 2:
        return []
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = np.concatenate([i for i, _ in sets])
    counts = np.concatenate([c for _, c in sets])
    owner = np.repeat(np.arange(len(sets)), [len(i) for i, _ in sets])
    total = np.bincount(owner, counts, len(sets))
    order = np.argsort(ids, kind="stable")
    ids, counts, owner = ids[order], counts[order], owner[order]
    found = []
    # the largest component is compared from the side of the others
    for k in np.flatnonzero(number != np.bincount(number).argmax()).tolist():
        own, c = sets[k]
        lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        size = hi - lo
        stop = np.cumsum(size)
        at = np.arange(int(stop[-1])) - np.repeat(stop - size - lo, size)
        both = np.bincount(owner[at], np.minimum(counts[at], np.repeat(c, size)), len(sets))
        like = both / (total + total[k] - both)
        near = (like >= THRESHOLD) & (number != number[k])
        if across:
            near &= chunk != chunk[k]
        for j in np.flatnonzero(near).tolist():
            x, y = find(number[k]), find(number[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((digests[k], digests[j], float(like[j])))
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, x, y, chunk, digest, root, ids, counts) sorted by (band, x, y)."""

    def out(key: tuple, held: list[list]) -> pa.RecordBatch:
        chunk, digest, root, ids, counts = held
        links = block_links(digest, root, np.array(chunk), [_set(i, c) for i, c in zip(ids, counts, strict=True)], key[1] != key[2])
        cols = list(zip(*links, strict=True)) or [[], [], []]
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.float64()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "likeness"])

    now, held = None, [[], [], [], [], []]
    for batch in batches:
        for band, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (band, x, y) != now:
                if now:
                    yield out(now, held)
                now, held = (band, x, y), [[], [], [], [], []]
            for col, v in zip(held, row, strict=True):
                col.append(v)
    if now:
        yield out(now, held)


def near_duplicate_components(texts: DataFrame) -> DataFrame:
    """texts: (digest, text), copies allowed. (node, root) of the classes that have a link."""
    parts = partitions(texts)
    signed = stored(
        texts.mapInArrow(lean(_sign), "digest binary, sig binary").filter("sig is not null").groupBy("digest").agg(F.max("sig").alias("sig")), "signatures"
    )
    bands = signed.mapInArrow(lean(_bands), "band long, digest binary")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(bands.hint("merge").join(sizes, "band"), "bands")
    salt = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / BLOCK)).cast("int")

    # centres of parts of at most about BLOCK classes; where a band has several parts, their centres meet in the same way
    parted = shared.hint("merge").join(signed, "digest").select("band", salt.alias("part"), "digest", "sig")
    dealt = parted.repartition(parts, "band", "part").sortWithinPartitions("band", "part")
    stars = stored(dealt.mapInArrow(lean(_centres), "band long, part int, a binary, b binary"), "stars")
    many = shared.filter(F.col("n") > BLOCK).select("band").distinct()
    tops = stars.select("band", "a").distinct().join(many, "band")
    top = tops.groupBy("band").agg(F.min("a").alias("top"))
    across = tops.join(top, "band").select(F.col("top").alias("a"), F.col("a").alias("b"))
    pairs = stored(stars.select("a", "b").union(across).filter("a <> b").distinct(), "pairs")

    wanted = shared.select("digest").distinct()
    once = texts.mapInArrow(lean(_first_seen), "digest binary, text string").hint("merge").join(wanted, "digest", "left_semi")
    sets = once.mapInArrow(lean(_sets), "digest binary, ids binary, counts binary")
    sets = stored(sets.repartition(parts, "digest").mapInArrow(lean(_first_seen), sets.schema), "sets")

    # a centre goes to as many tasks as it has BLOCKs of classes to compare
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = pairs.hint("merge").join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = placed.hint("merge").join(sets.withColumnRenamed("digest", "b"), "b").select("a", "part", "b", "ids", "counts")
    centres = sets.hint("merge").join(spread.withColumnRenamed("a", "digest"), "digest").select(
        F.col("digest").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "ids", "counts"
    )
    met = members.union(centres).repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull())
    links = stored(met.mapInArrow(lean(_verify), "a binary, b binary, likeness double"), "links")
    roots = connected_components(links, "a", "b")

    # bands whose classes still lie in several components may hold links that no centre has
    of = F.coalesce(F.col("root"), F.col("digest")).alias("root")
    named = shared.filter("n > 2").hint("merge").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("band", "n", "digest", of)
    named = stored(named, "named")
    mixed = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = (
        named.hint("merge").join(mixed, "band")
        .withColumn("chunk", F.pmod(F.xxhash64("digest"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "digest", "root")
        .hint("merge").join(sets, "digest")
        .select("band", "x", "y", "chunk", "digest", "root", "ids", "counts")
    )
    rest = rest.repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y")
    more = stored(rest.mapInArrow(lean(_blocks), "a binary, b binary, likeness double"), "more-links")
    drop(signed, shared, stars, pairs, sets, links, named)
    return join_components(roots, more, "a", "b")


def _leaders(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """ids: (doc_id, digest). (digest, group_id, leads, group_size) of each class: leads where the group's first row has its text."""
    classes = ids.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    groups = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "digest")).alias("first"), F.sum("copies").alias("group_size"))
    return named.join(groups, "root").select(
        "digest", F.col("first.least").alias("group_id"), (F.col("first.digest") == F.col("digest")).alias("leads"), "group_size"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the class: its smallest doc_id), group_size, keep (one row of each group)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text_of(docs))).alias("digest"), text_of(docs).alias("text"))
    ids = rows.select("doc_id", "digest")
    of = _leaders(ids, near_duplicate_components(rows.select("digest", "text")))
    first = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("group_id"))
    # rows that repeat are counted, so that one of them is kept
    times = ids.join(of, "digest").groupBy("doc_id", "group_id", "group_size", first.alias("first")).agg(F.count("*").alias("n"))
    each = times.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("doc_id", "group_id", "group_size", (F.col("first") & (F.col("k") == 1)).alias("keep"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.unhex(F.md5(text_of(docs))).alias("digest"), row_of(docs).alias("row"), text_of(docs).alias("text"))
    roots = near_duplicate_components(rows.select("digest", "text"))
    of = _leaders(rows.select(F.col("id").alias("doc_id"), "digest"), roots).filter("leads").select("digest", "group_id")
    once = Window.partitionBy("digest").orderBy("id")
    found = rows.select("id", "digest", "row").join(of, "digest").filter(F.col("id").eqNullSafe(F.col("group_id")))
    return found.withColumn("n", F.row_number().over(once)).filter("n = 1").select("row.*")
