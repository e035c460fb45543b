"""Hybrid search over a batch of queries as one plan, and its meta row for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import ranking
from corvane.operators.dense import dense_top
from corvane.operators.sparse import sparse_top
from corvane.sources.scratch import written


def retrieve(points: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(dense list, sparse list) of the queries (query_id, text, embedding) over points (doc_id, text, embedding), each a table, as several steps read them.

    Points and queries are read several times too: what is dear to make should be a table.
    """
    dense = dense_top(points, queries, k, id="doc_id")
    sparse = sparse_top(points.select("doc_id", "text"), queries.select("query_id", "text"), k)
    return written(dense, "dense"), written(sparse, "sparse")


def candidates(points: DataFrame, queries: DataFrame, fused: DataFrame, most: int) -> DataFrame:
    """Fused rows up to most, with the sets of words of the point's text (bounded as a reranker gets it) and of the query's, each made once and not for every pair."""
    texts = queries.select("query_id", X.lower_words(F.col("text")).alias("query"))
    wanted = fused.where(F.col("rank") <= most).select("query_id", "doc_id")
    said = points.select("doc_id", X.lower_words(X.bounded(F.col("text"), ranking.TEXT_CHARS)).alias("text"))
    return wanted.join(said, "doc_id").join(texts, "query_id")


def meta(queries: DataFrame, dense: DataFrame, sparse: DataFrame, ranked: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """A row for each query: candidates, best scores, whether it was reranked, and the gate."""
    lists = (dense, "dense_candidates", "top_dense_score"), (sparse, "sparse_candidates", "top_sparse_score"), (ranked, "n_results", "top_rerank_score")
    rows = queries.select("query_id")
    for part, n, best in lists:
        rows = rows.join(part.groupBy("query_id").agg(F.count("*").alias(n), F.max("score").alias(best)), "query_id", "left")
    rows = rows.select("query_id", "dense_candidates", "sparse_candidates", "top_dense_score", "top_rerank_score", "n_results")
    for name in ("dense_candidates", "sparse_candidates", "n_results"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0)))
    rows = rows.withColumn("reranked", F.col("n_results") > 0).withColumn("low_confidence", ranking.low_confidence(F.col("top_rerank_score"), F.col("top_dense_score")))
    return rows.withColumn("needs_expansion", ranking.needs_expansion(F.col("n_results"), F.col("reranked"), F.col("top_rerank_score")))


def search(points: DataFrame, queries: DataFrame, limit: int = 10, most: int = 50, variants: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, meta). variants: (query_id, variant_id, text, embedding) of queries to expand; their lists join the fusion where the first pass calls for it.

    points: (doc_id, text, embedding[, table_markdown]). Results: query_id, source_id, doc_id, text, score, rank.
    """
    dense, sparse = retrieve(points, queries, most)
    ranked = _reranked(points, queries, [dense, sparse], limit, most)
    about = meta(queries, dense, sparse, ranked)
    if variants is not None:
        wanted = about.where("needs_expansion").select("query_id")
        more = variants.join(wanted, "query_id", "left_semi")
        lists = [dense, sparse, *expansion_lists(points, more, most)]
        again = _reranked(points, queries.join(wanted, "query_id", "left_semi"), lists, limit, most)
        ranked = ranked.join(wanted, "query_id", "left_anti").unionByName(again)
        about = meta(queries, dense, sparse, ranked)
    return ranking.results(ranked, points.select("doc_id", "text", *(c for c in ("table_markdown",) if c in points.columns))), about


def _reranked(points: DataFrame, queries: DataFrame, lists: list[DataFrame], limit: int, most: int) -> DataFrame:
    """The queries' lists fused and reranked; both are tables of known size, so that texts needn't be shuffled to meet small ones."""
    fused = written(ranking.fuse(lists).where(F.col("rank") <= most), "fused")
    return written(ranking.rerank(candidates(points, queries, fused, most), limit), "reranked")


def expansion_lists(points: DataFrame, variants: DataFrame, most: int) -> list[DataFrame]:
    """The two lists of all variants; each variant is a query of its own until fusion, where its rows count for its query."""
    keyed = variants.select(F.col("variant_id").alias("query_id"), "text", "embedding")
    names = variants.select(F.col("query_id").alias("_q"), F.col("variant_id").alias("_v"))
    return [x.withColumnRenamed("query_id", "_v").join(names, "_v").select(F.col("_q").alias("query_id"), "doc_id", "rank") for x in retrieve(points, keyed, most)]
