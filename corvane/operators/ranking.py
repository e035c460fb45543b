"""What happens to candidates: fusion, reranking, the refusal gate, expansion, results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.lexical import top

#: Rank constant, thresholds of the gate and of expansion, characters of a result.
RRF_K, MIN_RERANK, MIN_DENSE, MIN_EXPAND, TEXT_CHARS = 60, 0.45, 0.6, 0.3, 4000


def fuse(lists: list[DataFrame], k: int = RRF_K, query: str = "query_id", id: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query, id, rank): (query, id, score, rank, first_list)."""
    marked = [x.select(query, id, "rank", F.lit(i).alias("_list")) for i, x in enumerate(lists)]
    summed = reduce(DataFrame.unionByName, marked).groupBy(query, id).agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min("_list").cast("long").alias("first_list"))
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), F.asc(id))
    return summed.select(query, id, F.round("score", 9).alias("score"), F.row_number().over(best).cast("long").alias("rank"), "first_list")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def rerank(candidates: DataFrame, limit: int, query_text: str = "query", text: str = "text", query: str = "query_id", id: str = "doc_id", chars: int = TEXT_CHARS) -> DataFrame:
    """The best `limit` candidates by word overlap with the query, as a cross-encoder's stand-in. Texts are bounded to `chars`; arrays are sets of words that were made before."""
    made = {c for c, kind in candidates.dtypes if kind.startswith("array")}
    asked = F.col(query_text) if query_text in made else X.lower_words(F.col(query_text))
    said = F.col(text) if text in made else X.lower_words(X.bounded(F.col(text), chars))
    both = candidates.select(query, id, F.size(asked).alias("_a"), F.size(said).alias("_b"), F.size(F.array_intersect(asked, said)).alias("_n")) if {query_text, text} <= made else None
    score = F.when((F.col("_a") == 0) | (F.col("_b") == 0), 0.0).otherwise(F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n")))  # jaccard of sets, met once
    scored = candidates.select(query, id, jaccard(asked, said).alias("score")) if both is None else both.select(query, id, score.alias("score"))
    return top(scored, limit, query=query, id=id)


def unknown_ids(returned: DataFrame, supplied: DataFrame, query: str = "query_id", id: str = "doc_id") -> DataFrame:
    """Ids that a reranker returned but wasn't given; there must be none."""
    return returned.join(supplied.select(query, id), [query, id], "left_anti")


def low_confidence(top_rerank: Column, top_dense: Column, dense_available: Column | None = None) -> Column:
    """The refusal gate: the rerank score decides, the dense score where there is none."""
    available = F.lit(True) if dense_available is None else dense_available
    return F.when(top_rerank.isNotNull(), top_rerank < MIN_RERANK).otherwise(F.coalesce(available & (top_dense < MIN_DENSE), F.lit(False)))


def needs_expansion(results: Column, reranked: Column, top_rerank: Column, enabled: bool = True) -> Column:
    """No results, or reranked ones that score too low."""
    return F.lit(enabled) & ((results == 0) | (reranked & F.coalesce(top_rerank < MIN_EXPAND, F.lit(False))))


def results(ranked: DataFrame, payload: DataFrame, query: str = "query_id", id: str = "doc_id", chars: int = TEXT_CHARS, full_table: bool = True) -> DataFrame:
    """Result rows: label S1, S2 and so on, and the text (the whole table if there is one and it is asked for), bounded."""
    text = F.coalesce(F.when(F.col("table_markdown") != "", F.col("table_markdown")), F.col("text")) if full_table and "table_markdown" in payload.columns else F.col("text")
    return ranked.join(payload, id).select(query, F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"), id, X.bounded(text, chars).alias("text"), "score", "rank")
