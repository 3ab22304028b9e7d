"""Vectorised word and shingle hashes of many texts at once.

Words are the runs between ASCII white space of the lower-cased text in UTF-8. A shingle is `width` consecutive words; a
text of fewer words (but one at least) has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PERIOD = 4096
_MULT = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_PLACE = mix(np.arange(1, _PERIOD + 1, dtype=np.uint64) * _MULT) | U(1)
_STEP = mix(np.arange(101, 165, dtype=np.uint64) * _MULT) | U(1)


def groups_of(texts: list[str], most: int = 2_000_000):
    """Consecutive groups of texts of about `most` characters, to bound memory."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the end of its words among them."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    b = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.array([], np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(~space)
    lengths = stops - starts
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    h = np.add.reduceat((b[at].astype(np.uint64) + U(1)) * _PLACE[place % _PERIOD], firsts)
    return mix(h + lengths.astype(np.uint64) * _MULT), np.searchsorted(starts, ends)


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and for each text the end of its shingles among them."""
    words, ends = word_hashes(texts)
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.where(ends > begins, np.maximum(1, ends - begins - width + 1), 0)
    stops = np.cumsum(counts)
    first = np.arange(counts.sum()) - np.repeat(stops - counts, counts) + np.repeat(begins, counts)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    h = np.zeros(len(first), np.uint64)
    for k in range(width):
        h += padded[first + k] * _STEP[k]
    for i in np.flatnonzero((ends > begins) & (ends - begins < width)):
        own = words[begins[i] : ends[i]]
        h[stops[i] - 1] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + U(len(own))
    return mix(h), stops
