"""Repeated passages by a hash-compared suffix sort.

Every byte is found that a string of `length` bytes covers which also starts anywhere else. Texts are too many to sort all
their suffixes, so places that can match are brought together first, without loss:

1. Each window of `length` bytes names an anchor: its least hash of `gram` bytes (the leftmost of equals). The choice depends
   on the window's bytes alone, so equal windows name anchors of equal bytes at the same distance. The windows of an anchor
   are consecutive; its context is all their bytes. Rows (anchor hash, 128-bit context digest, place) are dealt by anchor hash,
   those of a heavy anchor by context digest too. Equal contexts repeat as a whole and are settled; anchors that occur once are
   dropped.
2. What is left are anchors with different contexts. Their bytes are fetched, and in each group of equal anchors the suffixes
   right of the anchor, and the reversed prefixes left of it, are sorted by a mergesort. Two suffixes are compared through
   prefix polynomial hashes: binary search finds their common extension, the byte after it their order. Neighbours' common
   extensions are verified byte by byte; on a collision the sort is repeated on bytes. Windows at distance d are equal exactly
   if the left extension is d at least and the right one reaches the window's end, so windows are compared by their places in
   both orders.
3. A group of more than HOT different contexts, or of a heavy anchor, is not sorted in one task: its windows are dealt by a
   128-bit digest instead and counted, which settles them as exactly.

Heavy anchors are those with a SHARE-th of all contexts and HEAVY at least: found by counting all rows, where each task reports
what is frequent in it. Settled windows become spans, which are gathered by text digest and cut from the texts. Texts and whole
contexts are told apart by 128-bit digests, extensions in a sort by their bytes.

Defined results: null counts as empty text, and stays null where texts are cut; texts shorter than `length` bytes keep all;
copies of a text (repeated rows too) of `length` bytes at least lose all; an empty table gives no rows; a null doc_id is kept;
columns of any name go along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import delete, drop_at_exit, shared_dir
from .common import lean, partitions, stored, text_of
from .textvec import U, mix

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1  # windows that may name the same anchor
HOT = 20_000
PART = 1_000_000  # rows of one anchor held at once
HEAVY, SHARE = HOT, 1_000  # contexts of a heavy anchor at least, and the part of all contexts
SALTS = 64  # tasks that a heavy anchor is dealt to at most
_BITS = 20
_CHUNK = 1 << _BITS
_BASE = 0x9E3779B97F4A7C15 | 1
ROW_SCHEMA = "kind int, anchor long, context long, more long, t1 long, t2 long, at long, lo int, hi int, n int"
_NAMES = ["kind", "anchor", "context", "more", "t1", "t2", "at", "lo", "hi", "n"]
_TYPES = [pa.int32(), *[pa.int64()] * 6, *[pa.int32()] * 3]
SETTLED, OPEN = 0, 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, once for each worker."""
    if not hasattr(_powers, "made"):
        inverse = pow(_BASE, -1, 2**64)
        both = []
        for b in (_BASE, inverse):
            x = np.full(_CHUNK + 1, U(b))
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers.made = tuple(both)
    return _powers.made


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts joined in b (at most 2**20 bytes): (place, first window, last window, hash) of each anchor."""
    none = np.array([], np.int64)
    if len(b) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    up, down = _powers()
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + U(1)) * up[: len(b)], out=prefix[1:])
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(b) - GRAM + 1])
    least = (grams & ~U(_CHUNK - 1)) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if SPAN > step:
        least = np.minimum(least[: step - SPAN], least[SPAN - step :])
    place = (least & U(_CHUNK - 1)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int32)
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(windows):
        return none, none, none, none.astype(np.uint64)
    named = place[windows]
    new = np.flatnonzero((np.diff(named) != 0) | (np.diff(windows) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new - 1, [len(windows) - 1]])
    return named[first], windows[first], windows[last], grams[named[first]]


def _chunks(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[tuple[int, int]]]]:
    """(bytes, ends, [(text, offset)]): texts joined up to the chunk size; longer texts in pieces that overlap by a window."""
    held, ends, who, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), _CHUNK - LENGTH + 1):
            part = t[at : at + _CHUNK]
            if len(part) < LENGTH:
                continue
            if size + len(part) > _CHUNK:
                yield b"".join(held), ends, who
                held, ends, who, size = [], [], [], 0
            held.append(part)
            size += len(part)
            ends.append(size)
            who.append((i, at))
    if held:
        yield b"".join(held), ends, who


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def text_key(data: bytes) -> tuple[int, int]:
    d = hashlib.md5(data).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
        keys = [text_key(t) for t in texts]
        cols: list[list] = [[] for _ in range(7)]
        for data, ends, who in _chunks(texts):
            b = np.frombuffer(data, np.uint8)
            ends = np.array(ends)
            place, first, last, hashes = anchors(b, ends)
            owner = np.searchsorted(ends, first, side="right")
            begins = np.concatenate([[0], ends[:-1]])
            offset = np.array([at for _, at in who]) - begins
            whose = np.array([i for i, _ in who])[owner]
            lo, hi = place - last, place - first
            start, stop = first, last + LENGTH
            digest = [xxhash.xxh3_128_digest(data[s:e], seed=d) for s, e, d in zip(start.tolist(), stop.tolist(), hi.tolist(), strict=True)]
            halves = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
            for c, v in zip(cols, (hashes.view(np.int64), halves[:, 0], halves[:, 1], whose, place + offset[owner], lo, hi), strict=True):
                c.append(v)
        if not cols[0]:
            continue
        anchor, context, more, whose, at, lo, hi = (np.concatenate(c) for c in cols)
        k = np.array(keys, np.int64).reshape(-1, 2)[whose]
        # equal contexts within the batch are settled here; one of them goes on for all
        order = np.lexsort((more, context, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(context[order]) != 0) | (np.diff(more[order]) != 0)
        group_of = np.cumsum(new) - 1
        n = np.bincount(group_of)
        lead = order[new]
        many = order[n[group_of] > 1]
        yield _rows(np.full(len(lead), OPEN), anchor[lead], context[lead], more[lead], k[lead, 0], k[lead, 1], at[lead], lo[lead], hi[lead], n)
        if len(many):
            yield _settled(k[many, 0], k[many, 1], at[many] - hi[many], at[many] - lo[many] + LENGTH)


def _rows(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _settled(t1: np.ndarray, t2: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A span [start, end) of a text whose bytes all repeat."""
    zero, none = np.zeros(len(t1), np.int64), np.zeros(len(t1), np.int32)
    return _rows(np.full(len(t1), SETTLED), zero, end, zero, t1, t2, start, none, none, none)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that make up half a SHARE-th of a task's rows, with their numbers: an anchor with a SHARE-th of all rows is reported
    by the tasks that hold half of them at least."""
    every = [np.asarray(batch.column(0)) for batch in batches]  # a task's part of one column
    values, counts = np.unique(np.concatenate([np.array([], np.int64), *every]), return_counts=True)
    total = counts.sum()
    often = counts * 2 * SHARE >= total
    yield pa.RecordBatch.from_arrays([pa.array(values[often], pa.int64()), pa.array(counts[often], pa.int64())], names=["anchor", "n"])


def heavy_anchors(rows: DataFrame) -> list[int]:
    """At most 2 * SHARE anchors, whatever the number of rows."""
    total = rows.count()
    found = rows.select("anchor").mapInArrow(lean(_frequent), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return [r.anchor for r in found.filter((F.col("n") * 2 * SHARE >= total) & (F.col("n") * 2 >= HEAVY)).select("anchor").collect()]


def _settle(heavy: list[int] | None = None):
    """Rows sorted by (anchor, context): settles contexts that repeat, drops lone anchors, passes on the rest. An anchor of more
    than PART rows is worked in parts, a heavy one in several tasks; none tells what the others hold, so all its contexts go on."""
    spread = np.sort(np.array(heavy or [], np.int64))

    def work(cols: list[np.ndarray], split: int | None) -> Iterator[pa.RecordBatch]:
        kind, anchor, context, more, t1, t2, at, lo, hi, n = cols
        if not len(kind):
            return
        new_anchor = np.concatenate([[True], np.diff(anchor) != 0])
        new_class = new_anchor | np.concatenate([[True], (np.diff(context) != 0) | (np.diff(more) != 0)])
        cls, grp = np.cumsum(new_class) - 1, np.cumsum(new_anchor) - 1
        times = np.bincount(cls, n)
        many = times[cls] > 1
        if many.any():
            yield _settled(t1[many], t2[many], at[many] - hi[many], at[many] - lo[many] + LENGTH)
        lead = np.flatnonzero(new_class)
        group = grp[lead]
        kinds = np.bincount(group)
        loose = np.bincount(group, times < 2)
        on = lead[(kinds[group] > 1) & (loose[group] > 0) | (anchor[lead] == split) | np.isin(anchor[lead], spread)]
        if len(on):
            yield _rows(*(c[on] for c in cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        split: int | None = None  # the anchor last cut into parts
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[1], cols[1][-1], side="left"))  # the last anchor may go on
            if not cut and len(cols[0]) > PART:
                cut, split = len(cols[0]), int(cols[1][-1])  # a part of a very large group; what it leaves open is settled later
            yield from work([c[:cut] for c in cols], split)
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from work(held, split)

    return run


# --- the sort -----------------------------------------------------------------------------------------------------------


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix of every row (bytes + 1; 0 beyond the end)."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    for j in range(rows.shape[1]):
        np.multiply(out[:, j], U(_BASE), out=out[:, j + 1])
        out[:, j + 1] += mix(rows[:, j].astype(np.uint64) + U(257))
    return out


def common(hashes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common prefix length of rows i and j by binary search over prefix hashes."""
    lo = np.zeros(len(i), np.int64)
    hi = np.full(len(i), hashes.shape[1] - 1)
    while True:
        on = lo < hi
        if not on.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = hashes[i, mid] == hashes[j, mid]
        lo = np.where(on & same, mid, lo)
        hi = np.where(on & ~same, mid - 1, hi)


def _before(rows: np.ndarray, hashes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether suffix i comes before suffix j (not if equal)."""
    at = np.minimum(common(hashes, i, j), rows.shape[1] - 1)
    return rows[i, at] < rows[j, at]


def suffix_sort(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows (ascending within groups, which are consecutive), and each one's common prefix with the one before it in
    the order (0 at a group's start). All merges of a round are done at once: a row's new place is its own in its run plus the
    number of rows before it in the other run, found by binary search."""
    n = len(rows)
    hashes = prefix_hashes(rows)
    order = np.arange(n)
    begin = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    largest = int((end - begin).max(initial=0))
    width = 1
    while width < largest:
        rel = np.arange(n) - begin
        run = begin + rel // width * width
        pair = begin + rel // (2 * width) * (2 * width)
        left = run == pair
        other = np.where(left, run + width, pair)
        stop = np.where(left, np.minimum(other + width, end), run)
        live = np.flatnonzero(np.minimum(pair + width, end) < end)  # the pair has a right run
        lo, hi = other[live].copy(), stop[live].copy()
        me, is_left = order[live], left[live]
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                break
            mid = (lo[on] + hi[on]) // 2
            they = order[mid]
            # equal rows keep their order: left ones first
            ahead = np.where(is_left[on], _before(rows, hashes, they, me[on]), ~_before(rows, hashes, me[on], they))
            lo[on] = np.where(ahead, mid + 1, lo[on])
            hi[on] = np.where(ahead, hi[on], mid)
        new = order.copy()
        new[pair[live] + (live - run[live]) + (lo - other[live])] = me
        order = new
        width *= 2
    shared = np.zeros(n, np.int64)
    if n > 1:
        shared[1:] = common(hashes, order[:-1], order[1:])
        shared[1:][group[1:] != group[:-1]] = 0
        # collision verification: the bytes themselves
        for s in range(1, n, 4096):
            e = min(n, s + 4096)
            a, b = rows[order[s - 1 : e - 1]], rows[order[s:e]]
            differ = a != b
            true = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
            true[group[s:e] != group[s - 1 : e - 1]] = 0
            if (true != shared[s:e]).any():
                order = np.lexsort((*rows.T[::-1], group))
                for k in range(1, n):
                    differ = rows[order[k]] != rows[order[k - 1]]
                    shared[k] = 0 if group[k] != group[k - 1] else (differ.argmax() if differ.any() else rows.shape[1])
                break
    return order, shared


def repeated_windows(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(rows x SPAN) booleans: whether the window at distance d left of the anchor repeats within its group. A context is the
    bytes from hi before the anchor to the end of the window at lo."""
    n = len(contexts)
    left = np.zeros((n, SPAN - 1), np.uint16)
    right = np.zeros((n, SPAN - 1), np.uint16)
    for i, c in enumerate(contexts):
        x = np.frombuffer(c, np.uint8).astype(np.uint16) + 1
        h = int(hi[i])
        left[i, :h] = x[:h][::-1]
        tail = x[h + GRAM :]
        right[i, : len(tail)] = tail
    (lorder, lshared), (rorder, rshared) = suffix_sort(left, group), suffix_sort(right, group)
    out = np.zeros((n, SPAN), bool)
    new_group = np.concatenate([[True], np.diff(group) != 0])
    lclass, rclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        on = np.flatnonzero((lo <= d) & (d <= hi))
        if len(on) < 2:
            continue
        lclass[lorder] = np.cumsum(new_group | (lshared < d))
        rclass[rorder] = np.cumsum(new_group | (rshared < SPAN - 1 - d))
        key = lclass[on] * (n + 1) + rclass[on]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        out[on, d] = count[at] > 1
    return out


def _spans(t1: list, t2: list, at: np.ndarray, found: np.ndarray) -> pa.RecordBatch | None:
    """Runs of repeated windows of each row as spans."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    if not len(row):
        return None
    # distances first .. last - 1: windows start at at - (last - 1) .. at - first
    return _settled(np.array(t1, np.int64)[row], np.array(t2, np.int64)[row], at[row] - (last - 1), at[row] - first + LENGTH)


def _sorted_groups(heavy: list[int] | None = None):
    """Rows (anchor, t1, t2, at, lo, hi, bytes) sorted by anchor. Groups are sorted some thousand contexts at a time; the
    windows of a hot group or a heavy anchor are passed on, each with its digest."""
    spread = frozenset(heavy or [])

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        anchor, t1, t2, at, lo, hi, data = zip(*rows, strict=True)
        found = repeated_windows(list(data), np.array(lo), np.array(hi), np.unique(np.array(anchor), return_inverse=True)[1])
        out = _spans(t1, t2, np.array(at, np.int64), found)
        if out is not None:
            yield out

    def windows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 500):
            digests, cols = [], [[], [], []]
            for _, t1, t2, at, lo, hi, data in rows[i : i + 500]:
                for d in range(lo, hi + 1):
                    digests.append(xxhash.xxh3_128_digest(data[hi - d : hi - d + LENGTH]))
                    for c, v in zip(cols, (t1, t2, at - d), strict=True):
                        c.append(v)
            half = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            zero = np.zeros(len(half), np.int32)
            yield _rows(np.full(len(zero), OPEN), half[:, 0], half[:, 1], zero, *cols, zero, zero, zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: list[tuple] = []
        hot, now = False, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if hot:
                        yield from windows(group)
                    else:
                        ready += group
                    if len(ready) > 4000:
                        yield from work(ready)
                        ready = []
                    group, hot, now = [], row[0] in spread, row[0]
                group.append(row)
                if len(group) > (500 if hot else HOT):
                    hot = True
                    yield from windows(group)
                    group = []
        if hot:
            yield from windows(group)
        else:
            ready += group
        yield from work(ready)

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, [(anchor, at, lo, hi)]) -> a row with its bytes for each place."""
    for batch in batches:
        for t1, t2, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            cols = [[w[k] for w in wanted] for k in ("anchor", "at", "lo", "hi")]
            own = [data[w["at"] - w["hi"] : w["at"] - w["lo"] + LENGTH] for w in wanted]
            n = len(wanted)
            arrays = [pa.array(c, t) for c, t in zip([cols[0], [t1] * n, [t2] * n, *cols[1:], own], _FETCHED, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "t1", "t2", "at", "lo", "hi", "bytes"])


_FETCHED = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _keyed(docs: DataFrame, *others: Column) -> DataFrame:
    """(t1, t2, text, ...): texts with their digests."""
    digest = F.md5(text_of(docs))
    half = [F.conv(F.substring(digest, k, 16), 16, -10).cast("long").alias(n) for k, n in ((1, "t1"), (17, "t2"))]
    return docs.select(*half, text_of(docs).alias("text"), *others)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(t1, t2, spans): the spans of each text (by digest) whose bytes repeat; they may overlap."""
    parts = partitions(docs)
    spark, place = docs.sparkSession, shared_dir(docs.sparkSession, "contexts")
    docs.select(text_of(docs).alias("text")).mapInArrow(lean(_find), ROW_SCHEMA).write.partitionBy("kind").parquet(place)
    drop_at_exit(spark, place)
    found = spark.read.schema(ROW_SCHEMA).parquet(place).select(*_NAMES)
    rows = found.filter(F.col("kind") == OPEN)
    heavy = heavy_anchors(rows)

    def part(by: Column) -> Column:
        """A heavy anchor is dealt to several tasks."""
        return F.when(F.col("anchor").isin(heavy), F.pmod(by, F.lit(SALTS))).otherwise(F.lit(0)) if heavy else F.lit(0)

    dealt = rows.withColumn("part", part(F.col("context"))).repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "context", "more")
    first = stored(dealt.drop("part").mapInArrow(lean(_settle(heavy)), ROW_SCHEMA), "anchors")
    delete(spark, f"{place}/kind={OPEN}")  # what is settled stays
    wanted = (
        first.filter(F.col("kind") == OPEN)
        .groupBy("t1", "t2")
        .agg(F.collect_list(F.struct("anchor", "at", "lo", "hi")).alias("wanted"))
    )
    sources = _keyed(docs).filter(F.octet_length("text") >= LENGTH).mapInArrow(lean(_first_seen), "t1 long, t2 long, text string")
    fetched = sources.join(wanted, ["t1", "t2"]).mapInArrow(
        _fetch, "anchor long, t1 long, t2 long, at long, lo int, hi int, bytes binary"
    )
    dealt = fetched.withColumn("part", part(F.xxhash64("t1", "at"))).repartition(parts, "anchor", "part").sortWithinPartitions("anchor")
    second = stored(dealt.drop("part").mapInArrow(lean(_sorted_groups(heavy)), ROW_SCHEMA), "sorted")
    windows = second.filter(F.col("kind") == OPEN)
    many = windows.groupBy("anchor", "context").agg(F.count("*").alias("times")).filter("times > 1")
    hot = windows.join(many, ["anchor", "context"]).select("t1", "t2", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    settled = [x.filter(F.col("kind") == SETTLED).select("t1", "t2", F.col("at").alias("start"), F.col("context").alias("end")) for x in (found, first, second)]
    every = reduce(DataFrame.unionByName, settled, hot)
    return every.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _cut(data: bytes, spans: list | None) -> tuple[bytes, int]:
    """What is left, and the number of maximal removed runs."""
    if not spans:
        return data, 0
    kept, at, runs, end = [], 0, 0, -1
    for s in sorted((s["start"], s["end"]) for s in spans):
        if s[0] > end:
            kept.append(data[at : s[0]])
            runs += 1
        end = max(end, s[1])
        at = end
    kept.append(data[at:])
    return b"".join(kept), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, runs = _cut(data, spans)
                rows.append((doc, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 4, pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _keyed(docs, docs["doc_id"].cast("long").alias("doc_id")).join(repeated_spans(docs), ["t1", "t2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns, with repeated bytes cut from text (a character that is cut in part goes) and n_chars renewed. A row
    without text stays as it is."""

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, s in zip(text, spans, strict=True):
            if s is None or not len(s):
                out.append(t)
            else:
                out.append(_cut(t.encode("utf-8", "surrogatepass"), list(s))[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    # the text itself does not travel in the row as well
    others = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns if c != "text"])
    keyed = _keyed(docs, others.alias("row"), docs["text"].isNull().alias("none"))
    got = keyed.join(repeated_spans(docs), ["t1", "t2"], "left").select("row", "none", cut("text", "spans").alias("text"))
    columns = []
    for c in docs.columns:
        out = F.col(f"row.`{c}`") if c != "text" else F.when(~F.col("none"), F.col("text"))
        if c == "n_chars":
            out = F.when(F.col("none"), out).otherwise(F.char_length("text").cast(docs.schema[c].dataType))
        columns.append(out.alias(c))
    return got.select(*columns)
