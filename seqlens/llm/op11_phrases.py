"""Phrase collocations by level-wise passes.

Pass k counts phrases of k words. It emits one only where both phrases of k - 1 words that overlap in it are frequent: these are
broadcast as a table of bits (BITS at most, whatever the corpus), so what a task is sent is bounded. A bit may let a phrase through
whose parts are rare; its count drops it then, so the levels are exact at any size. Every task counts within its batches first, by
exact word numbers, and Spark combines once more before it shuffles. Candidates are then cut, all cuts scored from the tables of
the levels by joins, and ranked within each language over salts first.

Words are bytes: only A-Z are lower-cased, and phrases compare in the order of UTF-8 bytes.

Defined results: a null text is empty, a null language `und`; an empty table gives no rows; repeated rows count each; texts of
any length are cut only between pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored, text_of
from .textvec import mix

U = np.uint64
#: Bits of the table of frequent phrases: a power of two, at most this one (32 MB).
BITS = 1 << 28
#: Bits for each frequent phrase in smaller tables.
SPARSE = 32
#: Bytes of text that are worked on together; a longer piece stays whole.
WINDOW = 3 << 20
LONGEST = 4

# The characters between pieces, [.,;:!?\x0A-\x0D], and those between words, [\x20\x09].
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_PLACES = mix(np.arange(11, 11 + LONGEST, dtype=np.uint64)) | U(1)
_LETTERS = mix(np.arange(1001, 1001 + 1024, dtype=np.uint64)) | U(1)
COUNTS = "lang string, phrase string, n long"


def _hashes(texts: pa.Array) -> np.ndarray:
    """A hash of each of an array of binaries, the same in every task."""
    if not len(texts):
        return np.array([], np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(b), dtype=np.int64) - np.repeat(starts, lengths)
    sums = np.concatenate([[U(0)], np.cumsum((b.astype(np.uint64) + U(1)) * _LETTERS[place & 1023])])
    return mix(sums[starts + lengths] - sums[starts] + lengths.astype(np.uint64))


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (mix(grams) >> U(20)) & U(bits - 1)


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of small whole numbers, and how often each occurs."""
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    n = len(columns)
    while sum(bits[:n]) > 63:
        n -= 1
    key = np.zeros(len(columns[0]), np.int64)
    for c, width in zip(columns[:n], bits, strict=False):
        key = (key << width) | c
    if n < len(columns):  # the first columns' distinct rows are numbered, and stand for them
        values, which = np.unique(key, return_inverse=True)
        (which, *rest), counts = _distinct([which, *columns[n:]])
        key = values[which]
    else:
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], np.int64)
        counts, key, rest = np.diff(np.append(edge, len(key))), key[edge], []
    out = []
    for width in reversed(bits[:n]):
        out.append(key & ((1 << width) - 1))
        key = key >> width
    return out[::-1] + rest, counts


def windows(texts: list[bytes], langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes of several texts, the ends of the texts in them and each text's language; pieces stay whole."""
    part, of, size = [], [], 0
    for text, lang in zip(texts, langs, strict=True):
        b = _LOWER[np.frombuffer(text, np.uint8)]
        while len(b):
            room = max(1, WINDOW - size)
            if len(b) > room:
                ends = np.flatnonzero(_KIND[b[:room]] == 2)
                cut = ends[-1] + 1 if len(ends) else 0
                if not cut and not size:  # a piece longer than a window
                    ends = np.flatnonzero(_KIND[b[room:]] == 2)
                    cut = room + ends[0] + 1 if len(ends) else len(b)
            else:
                cut = len(b)
            if cut:
                part.append(b[:cut])
                part.append(np.array([10], np.uint8))
                of.append(lang)
                size += cut + 1
                b = b[cut:]
            if len(b) or size >= WINDOW:
                yield np.concatenate(part), np.cumsum([len(x) for x in part])[1::2], np.array(of, object)
                part, of, size = [], [], 0
    if part:
        yield np.concatenate(part), np.cumsum([len(x) for x in part])[1::2], np.array(of, object)


class Words:
    """The words of a window in order: their number, piece and language, and the distinct ones."""

    def __init__(self, b: np.ndarray, ends: np.ndarray, langs: np.ndarray):
        kind = _KIND[b]
        inside = kind == 0
        edge = np.flatnonzero(np.concatenate([[inside[0]], inside[1:] != inside[:-1], [inside[-1]]]))
        starts, stops = edge[0::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])])
        coded = words.dictionary_encode()
        self.texts = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.names, codes = np.unique(langs, return_inverse=True)
        self.lang = np.repeat(codes, np.diff(np.searchsorted(starts, np.concatenate([[0], ends]))))

    def hashes(self) -> np.ndarray:
        """A hash of every place's word."""
        return _hashes(self.texts)[self.word]

    def languages(self) -> np.ndarray:
        """A hash of every place's language, which goes into a phrase once."""
        return _hashes(pa.array([_binary(x) for x in self.names], pa.binary()))[self.lang]


def _binary(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _gram_hashes(words: np.ndarray, langs: np.ndarray, k: int) -> np.ndarray:
    """Of the phrase of k words that begins at each place (where k words follow)."""
    n = max(0, len(words) - k + 1)
    h = langs[:n].copy()
    for j in range(k):
        h += words[j : n + j] * _PLACES[j]
    return h


def _counted(words: Words, at: np.ndarray, k: int) -> pa.RecordBatch:
    """Distinct phrases of k words that begin at these places, by language, with their counts."""
    met = np.zeros(len(words.texts), bool)
    own = [words.word[at + j] for j in range(k)]
    for ids in own:
        met[ids] = True
    number = np.cumsum(met) - 1
    (lang, *ids), n = _distinct([words.lang[at], *[number[x] for x in own]])
    texts = words.texts.filter(pa.array(met))
    phrase = pc.binary_join_element_wise(*[texts.take(pa.array(x)) for x in ids], pa.scalar(b" ", pa.binary()))
    names = pa.array(words.names.tolist(), pa.string()).take(pa.array(lang))
    as_text = pa.Array.from_buffers(pa.string(), len(phrase), phrase.buffers(), phrase.null_count, phrase.offset)
    return pa.RecordBatch.from_arrays([names, as_text, pa.array(n)], names=["lang", "phrase", "n"])


def _counter(k: int, table=None):
    """Mapper of (lang, text): counts of phrases of k words whose parts the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8) if table else None
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for window in windows(texts, batch.column(0).to_pylist()):
                w = Words(*window)
                n = max(0, len(w.word) - k + 1)
                fits = w.piece[:n] == w.piece[k - 1 :][:n]
                if bits is not None:
                    slots = _slots(_gram_hashes(w.hashes(), w.languages(), k - 1), len(bits) * 8)
                    known = (bits[slots >> U(3)] >> (slots & U(7)).astype(np.uint8)) & 1 == 1
                    fits &= known[:n] & known[1:][:n]
                yield _counted(w, np.flatnonzero(fits), k)

    return lean(run)


def _bit_table(level: DataFrame, k: int):
    """Broadcast bits of the frequent phrases of k words; the driver sees BITS at most."""
    n = level.count()
    bits = min(BITS, 1 << max(10, (SPARSE * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [p.split(b" ") for p in batch.column(1).cast(pa.binary()).to_pylist()]
            h = _hashes(batch.column(0).cast(pa.binary()))
            for j in range(k):
                h = h + _hashes(pa.array([w[j] for w in words], pa.binary())) * _PLACES[j]
            slots = _slots(h, bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.int64(1) << (slots & 63))], names=["place", "bit"])

    set_bits = level.mapInArrow(place, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[set_bits["place"].to_numpy()] = set_bits["bits"].to_numpy()
    return level.sparkSession.sparkContext.broadcast(table.tobytes())


def levels(docs: DataFrame, least: int = 30, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1, 2 ... words that occur `least` times, and (lang, n) of all words."""
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    count = lambda k, table=None: texts.mapInArrow(_counter(k, table), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = stored(count(1), "words")
    out = [words.filter(F.col("n") >= least)]
    for k in range(2, longest + 1):
        table = _bit_table(out[-1], k - 1)
        out.append(stored(count(k, table).filter(F.col("n") >= least), f"phrases-{k}"))
        table.unpersist()
    return out, words.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), first, last - first + 1), " ")


def scored(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every candidate, with its lowest-scoring cut (the first of equal ones)."""
    every = found[0].select("lang", "phrase", "n")
    for level in found[1:]:
        every = every.unionByName(level)
    longer = found[1].withColumn("size", F.lit(2))
    for size, level in enumerate(found[2:], 3):
        longer = longer.unionByName(level.withColumn("size", F.lit(size)))
    cut = longer.withColumnRenamed("n", "a").withColumn("words", F.split("phrase", " ", -1)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "size", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(every.toDF("lang", side, name), ["lang", side])
    whole = "cast({} as decimal(20,0))".format
    score = F.expr(f"({whole('a')} * cast(2000000 as decimal(7,0))) div ({whole('l')} + {whole('r')})")
    return (
        cut.withColumn("score", score)
        .groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    )


def outermost(candidates: DataFrame, share: int = 80) -> DataFrame:
    """Without candidates that lie in a longer one with `share` percent of their count."""
    longer = candidates.filter("size > 2").select("lang", F.col("a").alias("n"), "size", F.split("phrase", " ", -1).alias("words"))
    inner = longer.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    most = inner.select("lang", _part(F.col("at"), F.col("at") + F.col("k") - 1).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("__most"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    held = F.coalesce(whole("__most") * 100 >= whole("a") * share, F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~held).drop("__most")


def first_of_each(candidates: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language, with their rank: over salts first, so that no task sorts a language's candidates."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in (4096, 64):
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        candidates = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).filter(F.col("rank") <= most)
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= most)


def phrases(docs: DataFrame, least: int = 30, most: int = 2000, share: int = 80, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of 2 to `longest` words of each language."""
    found, totals = levels(docs, least, longest)
    best = first_of_each(outermost(scored(found), share), most)
    rows = best.join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
