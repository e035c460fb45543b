"""A quality classifier without labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Each labeller votes good, bad or abstains on a whole text. The votes are gathered as a
histogram of vote patterns, which is bounded by 3 to the number of labellers whatever the input. Expectation-
maximisation over it estimates how each labeller votes on good and on bad texts and how many are good;
a pattern's posterior is its soft label. A linear scorer over hashed features is then trained on the posteriors of a bounded
sample and scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from math import log
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches, text_column, texts_of, with_plain_names, written
from corvane.llm.html import STOP_WORDS

BAD, GOOD, ABSTAIN = 0, 1, 2
#: Documents that the scorer is trained on, at most.
SAMPLE = 6000
DIMENSIONS = 1 << 16

_SENTENCE = re.compile(r"[.\n]+")
_MARKS = re.compile(r"([^\w\s])\1+")
_SYMBOLS = frozenset("#$%&*|<>{}[]=~^@\\_+/")


@dataclass
class Signals:
    """What the labellers look at."""

    words: int
    distinct: float
    adjacent: float  # words that repeat the word before them
    sentences: int
    repeated: float  # sentences that occurred before in the text
    upper: float
    letters: int
    symbols: float  # characters that are neither letters, digits, white space nor usual punctuation
    doubled: float  # runs of a repeated mark for each word
    bare: float  # words without a letter or digit
    stops: float


class Reader(dict):
    """Reads signals off whole texts. Made once in a task.

    Words of the same form share a profile: (letters, capitals, symbols, doubled marks, bare, function word, places of
    its features). The reader itself maps words to profiles' numbers and keeps up to `most` of them.
    """

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.profiles, self.numbers, self.quick = most, [], {}, {}

    def __missing__(self, word: str) -> int:
        core = word[:-1] if word[-1] in ".,;:!?" else word
        number = None
        if core.isalpha():
            # letters in a plain case and at most one mark: the profile follows from these few facts
            kind = 0 if core.islower() else 1 if core[0].isupper() and (len(core) == 1 or core[1:].islower()) else 2 if core.isupper() else None
            if kind is not None:
                low = core.lower()
                key = (kind, len(core), word[len(core) :], low if low in STOP_WORDS else None)
                number = self.quick.get(key)
                if number is None:
                    number = self.quick[key] = self.profile(word)
        if number is None:
            number = self.profile(word)
        if len(self) < self.most:
            self[word] = number
        return number

    def profile(self, word: str) -> int:
        """The number of a word's profile."""
        shape = _shape(word)
        profile = (
            sum(map(str.isalpha, word)), sum(map(str.isupper, word)), sum(map(_SYMBOLS.__contains__, word)), len(_MARKS.findall(word)),
            not any(map(str.isalnum, word)), shape[-1].startswith("stop "), tuple(place(f) for f in shape),
        )
        number = self.numbers.get(profile)
        if number is None:
            number = self.numbers[profile] = len(self.profiles)
            self.profiles.append(profile)
        return number

    def read(self, text: str) -> tuple[Signals, dict[int, int]]:
        """(signals, how often each feature place occurs among the words)."""
        words = text.split()
        n = max(1, len(words))
        parts = [p for s in _SENTENCE.split(text) if (p := s.strip())]
        letters = upper = symbols = doubled = bare = stops = 0
        places: dict[int, int] = {}
        for number, k in Counter(map(self.__getitem__, words)).items():
            a, b, c, d, e, f, own = self.profiles[number]
            letters += k * a
            upper += k * b
            symbols += k * c
            doubled += k * d
            bare += k * e
            stops += k * f
            for p in own:
                places[p] = places.get(p, 0) + k
        found = Signals(
            len(words), sum(len(set(words[at : at + WINDOW])) for at in range(0, len(words), WINDOW)) / n, sum(map(eq, words, words[1:])) / n, len(parts), 1 - len(set(parts)) / max(1, len(parts)),
            upper / max(1, letters), letters, symbols / max(1, len(text)), doubled / n, bare / n, stops / n,
        )
        return found, places


#: Words of a window in which different words are counted, so that a text's length says nothing by itself.
WINDOW = 500


def _between(value: float, good: float, bad: float) -> int:
    """Good up to `good`, bad from `bad`, else no vote."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


#: The labellers by name.
LABELLERS: dict[str, Callable[[Signals], int]] = {
    "symbols": lambda s: _between(s.symbols, 0.01, 0.06),
    "doubled marks": lambda s: _between(s.doubled, 0.02, 0.25),
    "bare marks": lambda s: _between(s.bare, 0.03, 0.2),
    "capitals": lambda s: ABSTAIN if s.letters < 20 else _between(s.upper, 0.15, 0.5),
    "repeated words": lambda s: _between(s.adjacent, 0.06, 0.3),
    "repeated sentences": lambda s: ABSTAIN if s.sentences < 4 else _between(s.repeated, 0.15, 0.5),
    "few different words": lambda s: ABSTAIN if s.words < 40 else _between(1 - s.distinct, 0.65, 0.85),
    "function words": lambda s: GOOD if s.stops >= 0.15 else BAD if s.words >= 20 and s.stops < 0.02 else ABSTAIN,
    "empty": lambda s: BAD if not s.letters else ABSTAIN,
}


def votes(s: Signals) -> str:
    """A digit for each labeller."""
    return "".join(str(vote(s)) for vote in LABELLERS.values())


def posteriors(histogram: dict[str, int], rounds: int = 100, smooth: float = 1.0) -> tuple[dict[str, float], np.ndarray, float]:
    """(posterior of good by pattern, P(vote | class, labeller votes) [labeller, class, vote], share of good) by EM.

    It starts from whether any labeller votes bad. An abstention says nothing.
    """
    patterns = sorted(histogram)
    if not patterns:
        return {}, np.zeros((0, 2, 2)), 0.5
    count = np.array([histogram[p] for p in patterns], dtype=float)
    cast = np.array([[int(c) for c in p] for p in patterns])
    hot = np.eye(3)[cast][:, :, :2]  # pattern, labeller, vote
    bad, good = (cast == BAD).sum(1), (cast == GOOD).sum(1)
    post = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.5))  # one bad vote speaks louder than many good: most texts pass most tests
    for _ in range(rounds):
        share = float((count * post).sum() / count.sum())
        share = min(max(share, 1e-4), 1 - 1e-4)
        model = np.stack([np.einsum("p,plv->lv", count * w, hot) + smooth for w in (1 - post, post)], axis=1)
        model /= model.sum(axis=2, keepdims=True)
        odds = np.einsum("plv,lv->p", hot, np.log(model[:, 1]) - np.log(model[:, 0])) + log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns, post.tolist(), strict=True)), model, share


def _shape(word: str) -> list[str]:
    """Features of a word's form."""
    letters = [c for c in word if c.isalpha()]
    kind = "none" if not letters else "upper" if len(letters) > 1 and all(c.isupper() for c in letters) else "lower" if all(c.islower() for c in letters) else "title" if word[0].isupper() else "mixed"
    tail = word[len(word.rstrip("#$%&*|!?.,;:<>-=~^@+_/\\")) :]
    found = [f"kind {kind}", f"tail {tail[:4]}", f"length {min(12, len(word))}"]
    if (low := word.lower().strip(".,;:!?")) in STOP_WORDS:
        found.append(f"stop {low}")
    return found


def place(name: str, dimensions: int = DIMENSIONS) -> int:
    return zlib.crc32(name.encode()) % dimensions


def features(s: Signals, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: word forms by their share, and binned signals."""
    total = max(1, s.words)
    values = {f: n / total for f, n in counts.items()}
    for name, v in (("distinct", s.distinct), ("adjacent", s.adjacent), ("repeated", s.repeated), ("upper", s.upper), ("symbols", 4 * s.symbols), ("doubled", s.doubled), ("bare", s.bare), ("stops", s.stops)):
        values[place(f"bin {name} {min(10, int(v * 10 + 0.5))}")] = 1.0
        values[place(f"value {name}")] = min(v, 2.0)
    values[place(f"bin words {min(14, total.bit_length())}")] = 1.0
    places = np.array(sorted(values), dtype=np.int64)
    return places, np.array([values[p] for p in places.tolist()])


@dataclass
class Scorer:
    """A linear scorer over hashed features."""

    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[places] @ values, -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets by full-batch Adagrad."""
    weights, bias = np.zeros(dimensions), 0.0
    if not rows:
        return Scorer(weights, bias)
    sizes = np.array([len(p) for p, _ in rows])
    places, values = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    g2, b2 = np.full(dimensions, 1e-8), 1e-8
    # either class weighs the same, so that a rare one is learnt too
    half = target.mean()
    weight = target / max(half, 1e-6) + (1 - target) / max(1 - half, 1e-6)
    weight /= weight.sum()
    for _ in range(rounds):
        z = np.bincount(row, weights=weights[places] * values, minlength=len(rows)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        g = np.bincount(places, weights=d[row] * values, minlength=dimensions) + decay * weights
        gb = float(d.sum())
        g2 += g * g
        b2 += gb * gb
        weights -= rate * g / np.sqrt(g2)
        bias -= rate * gb / b2**0.5
    return Scorer(weights, bias)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[Scorer, dict[str, float]]:
    """(scorer, posterior by vote pattern). Votes are taken over all docs; the scorer sees a sample by hash of the text."""
    pattern = T.StructType([T.StructField("votes", T.StringType()), T.StructField("h", T.LongType())])

    def cast_votes() -> Callable:
        reader = Reader()
        return lambda batch: iter([{"votes": [votes(reader.read(t)[0]) for t in texts_of(batch)], "h": batch.column("h")}])

    hashed = docs.select("text", F.xxhash64(F.lit(7), "text").alias("h"))
    cast = written(map_batches(hashed, cast_votes, pattern), "votes")
    histogram = {r["votes"]: r["n"] for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** labellers rows
    post, _, _ = posteriors(histogram)
    # the distinct texts of smallest hash: copies don't crowd the sample
    chosen = cast.groupBy("h").agg(F.min("votes").alias("votes")).orderBy("h").limit(sample)
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("votes", T.StringType()), T.StructField("places", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def featurize() -> Callable:
        reader = Reader()

        def work(batch):
            found = [features(*reader.read(t)) for t in texts_of(batch)]
            yield {"h": batch.column("h"), "votes": batch.column("votes"), "places": [p.astype("<i4").tobytes() for p, _ in found], "values": [v.astype("<f4").tobytes() for _, v in found]}

        return work

    picked = hashed.join(F.broadcast(chosen), "h").select("h", "votes", "text")  # at most `sample` rows are broadcast
    # one row of each text is enough; copies are dropped before they are featurized
    rows = {r["h"]: r for r in map_batches(picked.groupBy("h", "votes").agg(F.first("text").alias("text")), featurize, schema).collect()}
    ordered = [rows[h] for h in sorted(rows)]
    scorer = train([(np.frombuffer(r["places"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float)) for r in ordered], np.array([post[r["votes"]] for r in ordered]))
    return scorer, post


SCORED = T.StructType([T.StructField("votes", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """docs with votes, score (0 to 1, higher is better) and keep (score >= threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def make() -> Callable:
        own, reader = held.value, Reader()

        def work(texts: list[str]) -> list:
            read = [reader.read(t) for t in texts]
            scores = [own.score(*features(*r)) for r in read]
            return [[votes(s) for s, _ in read], scores, [x >= threshold for x in scores]]

        return work

    return docs.withColumn("_quality", text_column(make, SCORED)(F.col("text"))).select(*docs.columns, "_quality.*")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, votes, label (posterior of the votes), score, keep of every row. Null texts count as empty; repeated rows get equal values."""
    scorer, post = fit(docs)
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), scorer)
    # the posterior of each pattern that occurs: at most 3 ** labellers rows
    table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in sorted(post.items())], "votes string, label double")
    return scored.select("doc_id", "votes", "score", "keep").join(F.broadcast(table), "votes", "left").select("doc_id", "votes", "label", "score", "keep")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer keeps, columns as they were (extra columns too, whatever their names)."""
    scorer, _ = fit(docs)
    plain = with_plain_names(docs)
    return score(plain, scorer).where("keep").select(*plain.columns).toDF(*docs.columns)
