"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns words into a tape of symbols: insults, threats, targets, negation, reported speech, clause and
sentence ends. Three transducers are composed into one machine that reads the tape once: negation marks what stands in its
scope, reported speech what a sentence attributes to others, and the target transducer tells directed matches from bare ones.
The machine's outputs are matched clauses of a kind; a document's score is a logistic function of their weighted counts.

The lexicon holds a few words of each class and what is learned: words and word beginnings that are significantly more
frequent in labelled toxic texts (a Chernoff bound over all candidates; two toxic votes at least). The weights of the kinds are fitted by logistic
regression towards prior weights. Both use at most MAX_TRAIN labelled rows, chosen by a hash of their id, and only rows whose
crc32(doc_id as text) mod 3 is not 1; near copies among them share one vote. Scores see the text alone.

A line break ends a sentence.

Defined results: null counts as empty text; a text without a match gets the score of the bias; repeated rows give a row each;
equal texts have equal scores; other columns, whatever their names, are left alone;
a label other than 0 or 1 is no label; several labels of one id: the largest; without labels the prior weights hold; a null
doc_id is scored and not held out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, text_of
from .op7_near_dedup import COORDS, _band_keys, signatures, weighted_sets

MAX_TRAIN = 10_000
THRESHOLD = 0.7
OTHER, INSULT, WEAK, THREAT, TARGET, NOT, SAID, CLAUSE, SENTENCE = "oiwtynrcs"

#: Words of each class in the four languages of the corpus.
WORDS = {
    INSULT: "idiot idiots moron morons stupid imbecile dumb dumbass loser losers pathetic worthless scum trash garbage clown disgusting"
    " bastard bitch asshole jerk creep freak vermin filth idiota estúpido estúpida imbécil basura asqueroso connard imbécile idiote"
    " ordure dégueulasse dummkopf idioten trottel abschaum widerlich arschloch",
    THREAT: "kill murder destroy hurt beat stab shoot strangle burn crush matar matarte golpear tuer frapper détruire töten umbringen"
    " schlagen vernichten",
    TARGET: "you your you're u he she they them him her people everyone tú te usted ellos vous tu toi ils elles du dich euch sie ihr",
    NOT: "not no never isn't aren't wasn't don't doesn't didn't nunca jamás ne pas jamais nicht kein keine nie",
    SAID: "said says told called calls wrote claimed alleged quoted dijo dice dit déclaré sagte schrieb nannte",
}

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:,\n]")
_PREFIXES = (4, 5, 6)


class Transducer:
    """A total deterministic transducer: step(state, symbol) -> (state, outputs)."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step

    def compose(self, then: Transducer) -> Transducer:
        def step(state, symbol):
            a, b = state
            a, out = self.step(a, symbol)
            made = ""
            for x in out:
                b, y = then.step(b, x)
                made += y
            return (a, b), made

        return Transducer((self.start, then.start), step)

    def table(self, alphabet: str) -> tuple[dict, object]:
        """All reachable moves: {(state number, symbol): (state number, outputs)}."""
        number, todo, moves = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for x in alphabet:
                to, out = self.step(state, x)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                moves[number[state], x] = number[to], out
        return moves, number


_SCOPE = 3


def _negation(left: int, x: str) -> tuple[int, str]:
    """Matches within three words after a negation become negated (capital N before them); clause ends close the scope."""
    if x == NOT:
        return _SCOPE, OTHER
    if x in (CLAUSE, SENTENCE):
        return 0, x
    return max(0, left - 1), ("N" + x if left and x in (INSULT, WEAK, THREAT) else x)


def _reported(said: bool, x: str) -> tuple[bool, str]:
    """From a verb of saying to the sentence's end, matches are reported (capital R before them)."""
    if x == SAID:
        return True, OTHER
    if x == SENTENCE:
        return False, x
    return said, ("R" + x if said and x in (INSULT, WEAK, THREAT) else x)


#: Kinds of matched clauses with their prior weights; a small letter marks no target near.
KINDS = {"insult": 2.0, "insult_at": 3.0, "weak": 0.7, "threat": 0.3, "threat_at": 2.0, "negated": 0.2, "reported": 0.5}
_KIND = dict(zip("abcdefg", KINDS, strict=True))
_CODE = {k: c for c, k in _KIND.items()}
BIAS = -3.0


def _target(state: tuple[int, str, str], x: str) -> tuple[tuple[int, str, str], str]:
    """A target within three words before or two words after makes a match directed. State: words left in which the last
    target counts, marks read before a match, match that still waits for a target (and for how long)."""
    near, marks, wait = state
    if x in "NR":
        return (near, marks + x if x not in marks else marks, wait), ""
    out = ""
    if wait:
        kind, left = wait[0], int(wait[1])
        if x == TARGET:
            out, wait = _CODE["insult_at" if kind == INSULT else "threat_at"], ""
        elif x in (CLAUSE, SENTENCE) or left <= 1 or x in (INSULT, WEAK, THREAT):
            out, wait = _CODE["insult" if kind == INSULT else "threat"], ""
        else:
            wait = f"{kind}{left - 1}"
    if x in (INSULT, WEAK, THREAT):
        if marks:
            out += _CODE["negated" if "N" in marks else "reported"]
        elif x == WEAK:
            out += _CODE["weak"]
        elif near:
            out += _CODE["insult_at" if x == INSULT else "threat_at"]
        else:
            wait = f"{x}2"
        marks = ""
    near = _SCOPE if x == TARGET else 0 if x == SENTENCE else max(0, near - 1)
    return (near, "", wait), out


def grammar() -> tuple[dict, dict]:
    """The composed machine's moves and its states."""
    machine = Transducer(0, _negation).compose(Transducer(False, _reported)).compose(Transducer((0, "", ""), _target))
    return machine.table(OTHER + INSULT + WEAK + THREAT + TARGET + NOT + SAID + CLAUSE + SENTENCE)


class Lexicon(dict):
    """Word (as cut at blanks and line breaks) -> symbols; filled as words come, emptied at a size."""

    def __init__(self, learned: dict[str, str], limit: int = 300_000):
        super().__init__()
        self.words = {w: c for c, ws in WORDS.items() for w in ws.split()} | {k[1:]: c for k, c in learned.items() if k[0] == "="}
        self.begins = {k[1:]: c for k, c in learned.items() if k[0] == "^"}
        self.limit = limit

    def symbol(self, word: str) -> str:
        if word in ".!?\n":
            return SENTENCE
        if word in ",;:":
            return CLAUSE
        found = self.words.get(word)
        if found is None:
            found = next((self.begins[word[:n]] for n in _PREFIXES if word[:n] in self.begins), OTHER)
        return found

    def __missing__(self, token: str) -> str:
        if len(self) > self.limit:
            self.clear()
        got = "".join(map(self.symbol, _WORD.findall(token))) or (OTHER if token.strip() else "")
        if len(token) < 80:
            self[token] = got
        return got


class Scorer:
    def __init__(self, learned: dict[str, str], weights: list[float] | None = None):
        self.lexicon = Lexicon(learned)
        self.moves, self.states = grammar()
        self.weights = np.array(weights if weights is not None else [BIAS, *KINDS.values()])
        self.hit = re.compile(f"[{INSULT}{WEAK}{THREAT}]")

    def features(self, text: str) -> list[float]:
        """log(1 + matched clauses) of each kind."""
        tape = "".join(map(self.lexicon.__getitem__, text.lower().replace("\n", " \n ").split(" ")))
        if not self.hit.search(tape):
            return [0.0] * len(KINDS)
        state, out = 0, []
        moves = self.moves
        for x in tape + SENTENCE:
            state, made = moves[state, x]
            if made:
                out.append(made)
        count = Counter("".join(out))
        return [float(np.log1p(count[c])) for c in _KIND]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(features: np.ndarray, labels: np.ndarray, votes: np.ndarray, pull: float = 0.3) -> np.ndarray:
    """Logistic regression with a Gaussian prior around the prior weights (Newton steps); weights of matches stay positive."""
    prior = np.array([BIAS, *KINDS.values()])
    x = np.column_stack([np.ones(len(features)), features])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (votes * (p - labels)) + pull * (w - prior)
        h = (x * (votes * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w


def word_features(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in _PREFIXES if len(w) >= n}


def bound(candidates: int) -> float:
    """What a lexeme's gain has to exceed."""
    return float(np.log(100.0 * max(candidates, 1)))


def choose(counts: list[tuple[str, float, float]], positive: float, negative: float, candidates: int) -> dict[str, str]:
    """Lexemes whose share of toxic votes is above chance by a Chernoff bound over all candidates: insults where the share is
    high, weak ones where it is middling. A beginning covers the words and longer beginnings below it."""
    prior = positive / (positive + negative)
    good = {}
    for name, pos, neg in counts:
        n = pos + neg
        share = min(pos / n, 1 - 1e-9)
        if share <= prior:
            continue
        gain = n * (share * np.log(share / prior) + (1 - share) * np.log((1 - share) / (1 - prior)))
        if gain > bound(candidates) and share >= 0.5:
            good[name] = (share, pos)
    chosen: dict[str, str] = {}
    for name, (share, pos) in sorted(good.items(), key=lambda x: (len(x[0]), x[0])):
        body = name[1:]
        above = [good[f"^{body[:n]}"] for n in _PREFIXES if n < len(body) or name[0] == "=" if f"^{body[:n]}" in chosen]
        if any(a[0] >= share - 0.05 for a in above):
            continue
        # one word alone is a word, not a beginning
        if name[0] == "^" and any(w[0] == "=" and w[1:].startswith(body) and g[1] > 0.9 * pos for w, g in good.items()):
            continue
        chosen[name] = INSULT if share >= 0.8 else WEAK
    return chosen


def _votes(sig: list[tuple[str, bytes | None]]) -> dict[str, float]:
    """Near copies (a band of signatures in common) among the bounded sample share one vote."""
    parent = {k: k for k, _ in sig}

    def find(k: str) -> str:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first: dict[int, str] = {}
    for k, s in sig:
        if s is not None:
            for band in _band_keys(np.frombuffer(s, np.uint32).reshape(1, COORDS))[0].tolist():
                a, b = find(first.setdefault(band, k)), find(k)
                parent[max(a, b)] = min(a, b)
    size = Counter(find(k) for k in parent)
    return {k: 1 / size[find(k)] for k in parent}


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[dict[str, str], list[float] | None]:
    """(learned lexemes, weights) from at most `most` labelled rows; what reaches the driver is bounded by it."""
    spark = docs.sparkSession
    allowed = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    chosen = (
        allowed.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of(docs).alias("text"))
    # `most` ids at most are sent to all executors
    sample = rows.join(F.broadcast(chosen), "id").select(F.md5("text").alias("digest"), "toxic", "text")
    sample = stored(sample.groupBy("digest").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")), "toxic-sample")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = signatures(*weighted_sets(batch.column(1).to_pylist()))
                data = [s.tobytes() if s.any() else None for s in sigs]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["digest", "sig"])

    signed = sample.select("digest", "text").mapInArrow(lean(sign), "digest string, sig binary").collect()
    if not signed:
        return {}, None
    votes = _votes([(r.digest, r.sig) for r in signed])
    voted = sample.join(F.broadcast(spark.createDataFrame(list(votes.items()), "digest string, vote double")), "digest")
    positive, negative = voted.agg(F.sum(F.col("vote") * F.col("toxic")), F.sum(F.col("vote") * (1 - F.col("toxic")))).first()
    if not positive or not negative:
        return {}, None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()

        def out() -> pa.RecordBatch:
            names = list(pos.keys() | neg.keys())
            arrays = [pa.array(names, pa.string()), pa.array([float(pos[n]) for n in names]), pa.array([float(neg[n]) for n in names])]
            return pa.RecordBatch.from_arrays(arrays, names=["name", "pos", "neg"])

        for batch in batches:
            for text, toxic, vote in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = pos if toxic else neg
                for name in word_features(text):
                    to[name] += vote
                if len(pos) + len(neg) > 400_000:
                    yield out()
                    pos.clear()
                    neg.clear()
        if pos or neg:
            yield out()

    counted = voted.select("text", "toxic", "vote").mapInArrow(lean(count), "name string, pos double, neg double")
    counted = stored(counted.groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-words")
    candidates = counted.count()
    # the tests of choose, with some slack for rounding: only what can pass is sent to the driver
    n, prior = F.col("pos") + F.col("neg"), positive / (positive + negative)
    share = F.least(F.col("pos") / n, F.lit(1 - 1e-9))
    gain = n * (share * F.log(share / prior) + (1 - share) * F.log((1 - share) / (1 - prior)))
    likely = counted.filter((F.col("pos") >= 2) & (F.col("pos") >= F.col("neg")) & (gain > bound(candidates) - 1e-6)).collect()
    learned = choose([(r.name, r.pos, r.neg) for r in likely], positive, negative, candidates)

    scorer = Scorer(learned)
    kinds = len(KINDS)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer.features(t) for t in batch.column(0).to_pylist()]
            arrays = [pa.array(got, pa.list_(pa.float64())), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["features", "toxic", "vote"])

    got = voted.select("text", "toxic", "vote").mapInArrow(lean(featured), "features array<double>, toxic int, vote double").collect()
    x = np.array([r.features for r in got]).reshape(-1, kinds)
    weights = fit(x, np.array([r.toxic for r in got], float), np.array([r.vote for r in got]))
    return learned, weights.tolist()


def scores(docs: DataFrame, learned: dict[str, str], weights: list[float] | None) -> Column:
    """The score of each row's text."""
    made: list[Scorer] = []

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        if not made:
            made.append(Scorer(learned, weights))
        return pd.Series(made[0].score(np.array([made[0].features(t) for t in texts]).reshape(-1, len(KINDS))))

    return of(text_of(docs))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    doc = docs["doc_id"].cast("long")
    held_out = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 3 == 1, F.lit(False))
    scored = docs.select(doc.alias("doc_id"), held_out.alias("held_out"), scores(docs, *train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their columns, whose score is below the threshold."""
    return docs.filter(scores(docs, *train(docs, labels)) < THRESHOLD)
