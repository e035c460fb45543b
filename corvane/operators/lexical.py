"""Lexical encoding and search: postings, document frequencies, BM25 and sparse dot products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X
from corvane.functions.encoders import VOCABULARY, counted, place_of, stem_word
from corvane.sources.scratch import written

K1, B = 1.2, 0.75
#: Fixed value: the average length that stored lexical weights assume.
AVERAGE = 400


def tokens(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term) for each token, unstemmed."""
    return docs.select(id, F.explode(X.terms(F.col(text))).alias("term"))


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, tf, len): how often each term occurs and how many tokens the document has.

    The length is taken from the token array, so it needs no second shuffle.
    """
    listed = docs.select(id, X.terms(F.col(text)).alias("_t"))
    each = listed.select(id, F.size("_t").cast("long").alias("len"), F.explode("_t").alias("term"))
    return each.groupBy(id, "len", "term").agg(F.count("*").alias("tf")).select(id, "term", "tf", "len")


def _named(docs: DataFrame, id: str, text: str, name: Callable[[str], object], kind: T.DataType, key: str) -> DataFrame:
    listed = docs.select(id, X.terms(F.col(text)).alias("_t"))
    each = listed.select(id, F.size("_t").cast("long").alias("len"), F.explode(counted(F.col("_t"), name, kind)).alias("_c"))
    return each.select(id, F.col("_c.term").alias(key), F.col("_c.tf").alias("tf"), "len")


def stemmed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings by stem (id, term, tf, len), a document's counted where it stands: no shuffle. Rows that share an id are counted apart."""
    return _named(docs, id, text, stem_word, T.StringType(), "term")


def hashed(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """Postings by hashed stem (id, idx, tf, len), as stemmed; stems that share a place add up."""
    return _named(docs, id, text, lambda term: place_of(stem_word(term), vocabulary), T.LongType(), "idx")


def saturation(tf: Column, length: Column, average: Column | float) -> Column:
    """The weight of a term frequency: it levels off, and long documents count less."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def encode(posted: DataFrame, average: float, id: str = "doc_id", key: str = "term") -> DataFrame:
    """(id, key, weight) with a fixed average length, as the index stores it."""
    return posted.select(id, key, saturation(F.col("tf"), F.col("len"), float(average)).alias("weight"))


def vector(text: Column, average: float = AVERAGE, name: Callable[[str], int] | None = None) -> Column:
    """A text's lexical vector, (idx, weight) by idx: its stems by hashed place (or by `name`), counted where the text stands."""
    listed = X.terms(text)
    own = F.array(F.struct(counted(listed, name or (lambda term: place_of(stem_word(term))), T.LongType()).alias("c"), F.size(listed).alias("n")))  # made once, not for each term
    weigh = lambda s: F.transform(s["c"], lambda c: F.struct(c["term"].alias("idx"), saturation(c["tf"], s["n"], float(average)).alias("weight")))
    return F.array_sort(F.transform(own, weigh)[0])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n_docs, avgdl): all documents count, those without tokens too."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(X.terms(F.col(text)))).alias("avgdl"))


def frequencies(posted: DataFrame, id: str = "doc_id") -> DataFrame:
    """(term, df)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def top(scored: DataFrame, k: int, query: str = "query_id", id: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank: by score to nine places, then id. The score is rounded to six."""
    best = Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), F.asc(id))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query, id, F.round(score, 6).alias(score), F.col("rank").cast("long").alias("rank"))


#: Rows of query terms that are broadcast at most; more are joined by shuffle.
BROADCAST_TERMS = 200_000


def _near(terms: DataFrame) -> DataFrame:
    """The terms of queries, broadcast if they are few: then documents meet them where they stand, and no term is one task's."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


#: Stands for a document itself among its terms, which have two letters at least.
_ITSELF = ""


def matches(docs: DataFrame, queries: DataFrame, query_text: str = "text") -> DataFrame:
    """(doc_id, len, term, tf) of the queries' terms in documents, and a row with the term _ITSELF for each document, whose tf says how many rows it has.

    Documents are tokenized once, and only terms of the queries are shuffled. What reads this more than once should write it.
    """
    terms = _near(queries.select(F.explode(F.concat(F.array(F.lit(_ITSELF)), X.terms(F.col(query_text)))).alias("term")).distinct())
    listed = docs.select("doc_id", X.terms(F.col("text")).alias("_t"))
    hit = listed.select("doc_id", F.size("_t").alias("len"), F.explode(F.concat(F.array(F.lit(_ITSELF)), F.col("_t"))).alias("term")).join(terms, "term", "left_semi")
    return hit.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, query_text: str = "text", matched: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query by BM25 with measured length and frequency. queries: (query_id, text).

    Matches alone are returned. matched: what matches() gives, if it is there already; else it is made and written here.
    """
    matched = written(matches(docs, queries, query_text), "matches") if matched is None else matched
    wanted = _near(queries.select("query_id", F.explode(F.array_distinct(X.terms(F.col(query_text)))).alias("term")))
    stats = matched.where(F.col("term") == _ITSELF).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    posted = matched.where(F.col("term") != _ITSELF)
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = posted.join(_near(df), "term").crossJoin(F.broadcast(stats)).select("doc_id", "term", (idf * saturation(F.col("tf"), F.col("len"), F.col("avgdl"))).alias("w"))
    scored = weighted.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    return top(scored, k)


def sparse_dot(docs: DataFrame, queries: DataFrame, k: int, matched: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query by the dot product of stored weights and query counts; no document frequency. Only scores over 0. matched as in bm25."""
    asked = _near(queries.select("query_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("q")))
    matched = matches(docs, queries) if matched is None else matched
    weights = encode(matched.where(F.col("term") != _ITSELF), AVERAGE)
    return top(weights.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("weight")).alias("score")).where("score > 0"), k)


#: Ids of several rows that are broadcast at most.
BROADCAST_IDS = 1_000_000


def top_tokens(docs: DataFrame, k: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The k most frequent lower-case tokens of each id: (id, token, n, rank), ties by token.

    A document is counted where it stands: only ids that several rows share, found first, have their tokens shuffled.
    """
    words = docs.select(id, X.words(F.lower(text)).alias("_t"))
    several = docs.groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id).alias("_id"))
    n = several.limit(BROADCAST_IDS + 1).count()
    several = F.broadcast(several) if n <= BROADCAST_IDS else several
    same = F.col(id).eqNullSafe(F.col("_id"))
    alone = words.join(several, same, "left_anti") if n else words
    best = alone.select(id, F.posexplode(counted(F.col("_t"), None, T.StringType(), k)).alias("_p", "_c"))
    best = best.select(id, F.col("_c.term").alias("token"), F.col("_c.tf").alias("n"), (F.col("_p") + 1).cast("long").alias("rank"))
    if not n:
        return best
    each = words.join(several, same, "left_semi").select(id, F.explode("_t").alias("token")).groupBy(id, "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(id).orderBy(F.desc("n"), "token")).cast("long")
    return best.unionByName(each.withColumn("rank", rank).where(F.col("rank") <= k))
