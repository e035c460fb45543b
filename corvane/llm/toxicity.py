"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fitting takes a bounded sample of labelled rows of each class. Terms are words and word beginnings
of four to six letters (inflected forms share them); those whose log-likelihood ratio between the
classes is high enough, in favour of label 1, make up the TF-IDF space. The examples' postings form an inverted index in blocks
of examples, and each term keeps the largest weight it has in each block. A query adds these
maxima up to bounds for the blocks, and scores blocks from the highest bound down until no bound
can beat the k-th best cosine: the k nearest are exact. Their votes, weighted
by squared cosine and by the classes' sampling rates, with the base rate as a
pseudo-vote, give the score; the neighbours are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches, text_column, texts_of, with_plain_names, written

_LETTERS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6)

#: Labelled rows of each class in the sample, at most.
EXAMPLES = 4000
#: Terms kept, at most; the log-likelihood ratio that a term needs, and how much likelier it must be in label 1.
TERMS, LEAST_RATIO, LIFT = 20_000, 20.0, 10.0
BLOCK = 64
NEIGHBOURS = 15
#: Weight of the base rate in a vote.
PRIOR_WEIGHT = 0.2


def terms_of(word: str) -> list[str]:
    """The terms of a word: itself and, with a mark, its beginnings."""
    return [word, *(f"{word[:n]}*" for n in _BEGINNINGS if len(word) > n)]


def bag(text: str) -> Counter:
    return Counter(_LETTERS.findall(text.lower()))


@dataclass
class Index:
    """A block-max inverted index over labelled examples."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    weight: np.ndarray  # how many labelled rows of its class an example stands for, scaled
    rows: list[tuple[np.ndarray, np.ndarray]]  # terms and unit weights of each example
    base: float  # the rate of label 1
    prior: float = PRIOR_WEIGHT
    k: int = NEIGHBOURS
    bounds: np.ndarray = field(init=False)
    empty_score: float = field(init=False)

    def __post_init__(self):
        order = sorted(range(len(self.rows)), key=lambda i: (int(self.rows[i][0][self.rows[i][1].argmax()]) if len(self.rows[i][0]) else -1, int(self.toxic[i]), int(self.ids[i])))
        self.rows = [self.rows[i] for i in order]
        self.ids, self.toxic, self.weight = self.ids[order], self.toxic[order], self.weight[order]
        none = np.array([not len(t) for t, _ in self.rows], dtype=bool)
        self.empty_score = float(((self.weight * self.toxic)[none].sum() + self.prior * self.base) / (self.weight[none].sum() + self.prior))
        blocks, terms = -(-len(self.rows) // BLOCK), len(self.vocabulary)
        self.bounds = np.zeros((terms, blocks), dtype=np.float64)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for e, (t, w) in enumerate(self.rows):
            for a, b in zip(t.tolist(), w.tolist(), strict=True):
                postings[a].append((e, b))
        self.where = np.zeros((terms, blocks + 1), dtype=np.int32)
        docs, weights = [], []
        for t, posting in enumerate(postings):
            at = len(docs)
            counts = np.bincount([e // BLOCK for e, _ in posting], minlength=blocks)
            self.where[t, 0] = at
            self.where[t, 1:] = at + counts.cumsum()
            for e, w in posting:
                self.bounds[t, e // BLOCK] = max(self.bounds[t, e // BLOCK], w)
            docs += [e for e, _ in posting]
            weights += [w for _, w in posting]
        self.docs, self.weights = np.array(docs, dtype=np.int64), np.array(weights)

    def vector(self, words: Counter, cache: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """The unit TF-IDF vector of a bag of words."""
        counts: dict[int, int] = {}
        for word, n in words.items():
            got = cache.get(word)
            if got is None:
                got = tuple(v for t in terms_of(word) if (v := self.vocabulary.get(t)) is not None)
                if len(cache) < 500_000:
                    cache[word] = got
            for t in got:
                counts[t] = counts.get(t, 0) + n
        return unit_vector(counts, self.idf)

    def nearest(self, terms: np.ndarray, values: np.ndarray) -> list[tuple[float, int]]:
        """The k examples of largest cosine over 0, ties by place: exact."""
        best: list[tuple[float, int]] = []
        if not len(terms) or not len(self.rows):
            return best
        above = values @ self.bounds[terms]
        for b in np.argsort(-above, kind="stable").tolist():
            if above[b] <= 0 or len(best) == self.k and above[b] < best[-1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, v in zip(terms.tolist(), values.tolist(), strict=True):
                lo, hi = self.where[t, b], self.where[t, b + 1]
                if hi > lo:
                    scores[self.docs[lo:hi] - b * BLOCK] += v * self.weights[lo:hi]
            hit = np.flatnonzero(scores > 0)
            best = sorted([*best, *((float(scores[i]), b * BLOCK + int(i)) for i in hit)], key=lambda x: (-round(x[0], 12), x[1]))[: self.k]
        return best

    def score(self, terms: np.ndarray, values: np.ndarray) -> tuple[float, list[int]]:
        found = self.nearest(terms, values)
        if not found:
            return self.empty_score, []
        at = [i for _, i in found]
        votes = np.array([c * c for c, _ in found]) * self.weight[at]
        return float(((votes * self.toxic[at]).sum() + self.prior * self.base) / (votes.sum() + self.prior)), self.ids[at].tolist()


def unit_vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.array(sorted(counts), dtype=np.int64)
    values = np.array([1 + log(counts[t]) for t in terms.tolist()]) * idf[terms] if len(terms) else np.zeros(0)
    return terms, values / np.sqrt((values**2).sum()) if len(terms) else values


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: int = 5, examples: int = EXAMPLES) -> tuple[DataFrame, float, dict[int, float]]:
    """(doc_id, toxic, text) of at most `examples` labelled rows of each class, the rate of label 1, rows for each example by class.

    Only rows whose crc32(doc_id as text) mod held_out is not 0 are learnt from. Labels without an id or a
    value are passed over; of several labels of a document the highest counts. The sample is that of the
    smallest hashes of doc_id.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % held_out != 0).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen, rates, totals = [], {}, {}
    for label in (0, 1):
        mine = known.where(F.col("toxic") == label)
        totals[label] = mine.count()
        chosen.append(mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
        rates[label] = totals[label] / max(1, min(totals[label], examples))
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * examples rows of two numbers
    # one text of an id, should rows share it
    sample = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    both = sum(totals.values())
    return sample, totals[1] / both if both else 0.0, rates


def select_terms(sample: DataFrame, terms: int = TERMS, least: float = LEAST_RATIO) -> tuple[dict[str, int], np.ndarray]:
    """The terms that tell the classes apart, and their idf. Counted in a distributed way; at most `terms` come to the driver."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.IntegerType())])

    def make() -> Callable:
        def work(batch):
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                found = sorted({t for w in bag(text) for t in terms_of(w)})
                yield {"term": found, "toxic": [toxic] * len(found)}

        return work

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    n = n0 + n1
    if not n0 or not n1:
        return {}, np.zeros(0)
    counted = map_batches(sample, make, schema).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("df")).where("df >= 3")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, df = F.col("a"), F.col("df")
    b = df - a
    ratio = 2 * (part(a, df * n1 / n) + part(b, df * n0 / n) + part(n1 - a, (n - df) * n1 / n) + part(n0 - b, (n - df) * n0 / n))
    rows = counted.select("term", "a", "df", F.round(ratio, 6).alias("ratio")).where((F.col("ratio") >= least) & (F.col("a") * n0 >= LIFT * (F.col("df") - F.col("a")) * n1)).orderBy(F.desc("ratio"), "term").limit(terms).collect()
    vocabulary = {r["term"]: i for i, r in enumerate(sorted(rows, key=lambda r: r["term"]))}
    idf = np.zeros(len(rows))
    for r in rows:
        idf[vocabulary[r["term"]]] = log((1 + n) / (1 + r["df"])) + 1
    return vocabulary, idf


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 5, examples: int = EXAMPLES) -> Index:
    """The index over a bounded sample of labelled rows."""
    found, base, rates = labelled_sample(docs, labels, held_out, examples)
    sample = written(found, "toxic-sample")
    vocabulary, idf = select_terms(sample)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def make() -> Callable:
        def work(batch):
            rows = []
            for text in texts_of(batch):
                counts: Counter = Counter()
                for w, n in bag(text).items():
                    for t in terms_of(w):
                        if (v := vocabulary.get(t)) is not None:
                            counts[v] += n
                rows.append(counts)
            yield {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": [list(c) for c in rows], "counts": [list(c.values()) for c in rows]}

        return work

    rows = sorted(map_batches(sample, make, schema).collect(), key=lambda r: (r["doc_id"], r["toxic"], r["terms"]))  # at most 2 * examples rows
    vectors = [unit_vector(dict(zip(r["terms"], r["counts"], strict=True)), idf) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], dtype=np.int64)
    weight = np.array([rates[t] for t in toxic.tolist()], dtype=float)
    if len(weight):
        weight /= weight.max()
    return Index(vocabulary, idf, np.array([r["doc_id"] for r in rows], dtype=np.int64), toxic, weight, vectors, base)


SCORES = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))])


def score(docs: DataFrame, index: Index) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= 0.5) and evidence (the nearest examples' doc_ids).

    A text without terms of the index (null and empty texts too) gets the rate of label 1 among such
    examples, and no evidence. Nothing but the text is looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)

    def make() -> Callable:
        own, cache, done = held.value, {}, {}

        def work(texts: list[str]) -> list:
            scores, evidence = [], []
            for text in texts:
                terms, values = own.vector(bag(text), cache)
                key = (terms.tobytes(), values.tobytes())
                got = done.get(key)
                if got is None:
                    got = own.score(terms, values)
                    if len(done) < 20_000:
                        done[key] = got
                scores.append(got[0])
                evidence.append(got[1])
            return [scores, [int(s >= 0.5) for s in scores], evidence]

        return work

    return docs.withColumn("_toxicity", text_column(make, SCORES)(F.col("text"))).select(*docs.columns, "_toxicity.*")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row of docs."""
    index = fit(docs, labels, held_out)
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), index)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % held_out == 0).alias("held_out"), "score", "predicted", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """The rows of docs that aren't predicted toxic, columns as they were (extra columns too, whatever their names)."""
    plain = with_plain_names(docs)
    return score(plain, fit(docs, labels, held_out)).where("predicted = 0").select(*plain.columns).toDF(*docs.columns)
