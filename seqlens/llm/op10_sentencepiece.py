"""SentencePiece byte-pair encoding by vectorised merge rounds, and decoding.

A text is cut into words at its blanks (no piece reaches over the start of a run of blanks, which is checked when the model is
loaded). The distinct words of a batch become flat arrays of symbols. In each round every word finds its pair of best score
(segmented minimum of ranks) and merges its occurrences from the left, all words at once; a word's last merge of a round is the
first one that brings about a pair of better rank, as that pair comes next. Arrays are compacted, finished words leave, and
rounds end when no pair is left. A long word in which SPARE rounds merged less than a SLOW-th of the symbols is finished by a heap
of its pairs, in the same order, so that no text needs a number of rounds in proportion to its length. Characters without a piece
become byte pieces.

Defined results: null and empty texts have no ids; repeated rows give a row each; an empty table gives no rows; texts without
blanks, of blanks alone, or of millions of characters are encoded like any other.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of
from .textvec import groups_of

BLANK = "▁"
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*")
_NONE = np.iinfo(np.int32).max
_MULT = np.uint64(0x9E3779B97F4A7C15)
SLOW, SPARE = 256, 8


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (self.special[i] or sp.is_byte(i) or sp.is_unused(i))}
        if any(BLANK in p.lstrip(BLANK) for p in pieces) or sp.encode("a b") == []:
            raise ValueError("pieces reach over blanks")
        self.surface = [p.replace(BLANK, " ").encode() for p in map(sp.id_to_piece, range(n))]
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        for i in np.flatnonzero(self.special).tolist():
            self.surface[i] = b""
        self.surface[self.unknown] = sp.decode([self.unknown]).encode()
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_id.values())] = True
        # symbols: pieces by id, then single characters that are no pieces
        self.n = n
        self.of_point = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in pieces.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.not_text = frozenset(np.flatnonzero(self.special).tolist())
        self.seen: dict[str, tuple[tuple[int, ...], str]] = {}
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, made, rank = [], [], []
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if all(x in pieces or len(x) == 1 for x in (a, b)):
                    ids = [pieces[x] if x in pieces else self._char(x) for x in (a, b)]
                    keys.append(ids[0] << 32 | ids[1])
                    made.append(i)
                    rank.append(levels[score[p]])
        self.keys = np.array(keys, np.uint64)
        self.made, self.rank = np.array(made, np.int32), np.array(rank, np.int32)
        self._build_table()
        self._merges: dict[int, tuple[int, int]] | None = None
        # a merge is safe if every pair with the new symbol ranks no better than the pair merged
        least = np.full(n, _NONE, np.int64)
        for side in (self.keys >> np.uint64(32), self.keys & np.uint64(0xFFFFFFFF)):
            on = side < n
            np.minimum.at(least, side[on].astype(np.int64), self.rank[on])
        self.safe = least[self.made] > self.rank

    def _char(self, c: str) -> int:
        return self.n + ord(c)

    def _build_table(self) -> None:
        """Open addressing; `probes` is the longest chain."""
        self.shift = np.uint64(64 - 20)
        size = 1 << 20
        self.slot = np.full(size + 64, -1, np.int32)
        self.probes = 1
        for i, h in enumerate((self.keys * _MULT >> self.shift).tolist()):
            k = h
            while self.slot[k] >= 0:
                k += 1
            self.slot[k] = i
            self.probes = max(self.probes, k - h + 1)
        self.slot_key = np.where(self.slot >= 0, self.keys[self.slot], np.uint64(2**64 - 1))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, or -1."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = (key * _MULT >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            slot = at[todo]
            hit = self.slot_key[slot] == key[todo]
            out[todo[hit]] = self.slot[slot[hit]]
            todo = todo[~hit & (self.slot[slot] >= 0)]
            if not len(todo):
                break
            at[todo] += 1
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Piece ids of words, each a run of blanks (as ▁) and what follows it."""
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.of_point[points]
        word = np.repeat(np.arange(len(words)), lengths)
        done_word, done_sym, spent = [], [], np.zeros(len(words), np.int8)
        pair = self._pair_of(sym, word)
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == _NONE
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                sym, word, pair, rank, best = (x[~over] for x in (sym, word, pair, rank, best))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # occurrences: the leftmost of a word, and further ones of the same pair that do not overlap
            first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            same = pair[hit] == pair[hit[lead]]
            chain = np.concatenate([[True], (np.diff(hit) != 1) | first[1:]])
            odd = (np.arange(len(hit)) - np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))) % 2 == 1
            # overlapping hits of other pairs of equal rank would upset the parity: then only the leftmost is merged
            clean = np.bincount(word[hit], ~same, word[-1] + 1)[word[hit]] == 0
            hit = self._until_better(hit[first | (same & ~odd & clean)], sym, word, pair, best)
            if sizes.max() > SLOW:
                spent[self._slow(word, hit)] += 1
                slow = np.flatnonzero(spent == SPARE)
                spent[slow] = 0
                if len(slow):
                    out = np.isin(word, slow)
                    for k in slow.tolist():
                        ids = self._by_heap(sym[word == k])
                        done_word.append(np.full(len(ids), k))
                        done_sym.append(np.array(ids, np.int64))
                    sym, word, pair = sym[~out], word[~out], pair[~out]
                    continue
            sym[hit] = self.made[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            near = np.zeros(len(sym), bool)
            near[moved[hit]] = True
            near[np.maximum(moved[hit] - 1, 0)] = True
            touched = np.flatnonzero(near)
            nxt = np.minimum(touched + 1, len(sym) - 1)
            again = self.pairs(sym[touched], sym[nxt])
            again[(word[touched] != word[nxt]) | (nxt == touched)] = -1
            pair[touched] = again
        return self._ids(len(words), done_word, done_sym)

    def _until_better(self, hit: np.ndarray, sym: np.ndarray, word: np.ndarray, pair: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the places to merge, those of each word up to the first whose merge makes a pair as good as its own or better."""
        w, made = word[hit], self.made[pair[hit]]
        k = np.flatnonzero(~self.safe[pair[hit[:-1]]] & (w[1:] == w[:-1]))  # what is safe makes none; the last place is merged anyway
        if not len(k):
            return hit
        at = hit[k]
        before = np.maximum(at - 1, 0)
        left = sym[before]
        merged = (k > 0) & (hit[k - 1] + 1 == before) & (w[k - 1] == w[k])
        left = np.where(merged, made[k - 1], left)
        lefts, rights = self.pairs(left, made[k]), self.pairs(made[k], sym[at + 2])
        lefts[(at == 0) | (word[before] != word[at])] = -1
        rank = np.minimum(*(np.where(x >= 0, self.rank[x], _NONE) for x in (lefts, rights)))
        bad = np.zeros(len(hit), np.int64)
        bad[k] = rank <= best[at]
        earlier = np.cumsum(bad) - bad
        return hit[earlier == earlier[np.searchsorted(w, w)]]

    @staticmethod
    def _slow(word: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Long words of which a round would merge too little."""
        size, merged = np.bincount(word), np.bincount(word[hit], minlength=word[-1] + 1)
        return np.flatnonzero((size > SLOW) & (merged * SLOW < size))

    def _by_heap(self, start: np.ndarray) -> list[int]:
        """The symbols of one word after all merges, best rank first, leftmost of equals: pairs that are there are sorted, those
        that come about wait in a heap. A pair is named by rank << 32 | place, and stands if its place still has that rank."""
        if self._merges is None:
            self._merges = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        find, n = self._merges.get, len(start)
        pair = self.pairs(start[:-1], start[1:])
        at = np.flatnonzero(pair >= 0)
        ready = np.sort(self.rank[pair[at]].astype(np.int64) << 32 | at)[::-1].tolist()
        sym, nxt, prv = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[int] = []
        while ready or heap:
            code = heapq.heappop(heap) if heap and (not ready or heap[0] < ready[-1]) else ready.pop()
            i = code & 0xFFFFFFFF
            j = nxt[i]
            if j >= n or sym[i] < 0:
                continue
            merge = find(sym[i] << 32 | sym[j])
            if merge is None or merge[0] != code >> 32:
                continue
            sym[i], sym[j] = merge[1], -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if merge := find(sym[i] << 32 | sym[k]):
                    heapq.heappush(heap, merge[0] << 32 | i)
            h = prv[i]
            if h >= 0 and (merge := find(sym[h] << 32 | sym[i])):
                heapq.heappush(heap, merge[0] << 32 | h)
        return [s for s in sym if s >= 0]

    def _pair_of(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            pair[:-1] = self.pairs(sym[:-1], sym[1:])
            pair[:-1][word[1:] != word[:-1]] = -1
        return pair

    def _ids(self, n: int, words: list[np.ndarray], symbols: list[np.ndarray]) -> list[tuple[int, ...]]:
        if not words:
            return [()] * n
        word, sym = np.concatenate(words), np.concatenate(symbols)
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(n), side="right").tolist()
        flat, at, out = sym[order].tolist(), 0, []
        for end in ends:
            out.append(tuple(flat[at:end]))
            at = end
        for k in np.unique(word[sym >= self.n]).tolist():
            out[k] = tuple(x for s in out[k] for x in (self._bytes(s - self.n) if s >= self.n else (s,)))
        return out

    def _bytes(self, point: int) -> list[int]:
        data = chr(point).encode("utf-8", "surrogatepass")
        return [self.byte_id[b] for b in data] if self.byte_id else [self.unknown]

    def encode(self, texts: list[str], limit: int = 600_000) -> list[list[tuple[tuple[int, ...], str]]]:
        """For each text its words' (ids, ids in decimal). Words met are kept, without their blank, up to a limit."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " " or BLANK in t:
                cut.append([w[1:] for w in _WORDS.findall(BLANK + t.replace(" ", BLANK))])
            else:
                cut.append(t.split(" "))
        if len(self.seen) > limit:
            self.seen.clear()
        seen = self.seen
        fresh = list(set().union(*cut) - seen.keys()) if cut else []
        if fresh:
            ids = self.encode_words([BLANK + w for w in fresh])
            seen.update(zip(fresh, zip(ids, [",".join(map(str, x)) for x in ids], strict=True), strict=True))
        found = [list(map(seen.__getitem__, ws)) for ws in cut]
        for w in fresh:
            if len(w) > 64:
                del seen[w]
        return found

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, blanks restored, the blank before the text dropped; each byte that is not part of a valid character
        becomes U+FFFD."""
        if not ids:
            return ""
        data = b"".join([self.surface[i] for i in ids])
        first = next((i for i in ids if not self.special[i] or i == self.unknown), None)
        drop = first not in (None, self.unknown) and data[:1] == b" " and not self.is_byte[first]
        try:
            if self.not_text.isdisjoint(ids):
                return data.decode("utf-8")[drop:]
        except UnicodeDecodeError:
            pass
        # bytes count together only where their pieces follow each other
        out, run = [], bytearray()
        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                out += [*self._valid(run), self.surface[i].decode()]
                run.clear()
        return "".join([*out, *self._valid(run)])[drop:]

    @staticmethod
    def _valid(data: bytes | bytearray) -> Iterator[str]:
        at = 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    yield data[at : at + n].decode("utf-8")
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                yield "�"
                at += 1


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for part in groups_of(batch.column(1).to_pylist(), 8_000_000):
                for words in model.encode(part):
                    own, decimal = zip(*words, strict=True) if words else ((), ())
                    ids = list(chain.from_iterable(own))
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(decimal).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(model.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
