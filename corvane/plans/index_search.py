"""Hybrid search over the stored index: a table of requests in, results and a meta row for each request out.

A request has its own filters, limits and query vectors. The active version alone is read, excluded documents are left out,
and both lists come from what the index stores: no text is tokenized or encoded. What fails for a request (an encoder, the reranker, an unknown
document) is data in the tables: it becomes the request's status or a fallback that its meta row declares, and other requests go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import ranking
from corvane.operators.control import request_error, without
from corvane.operators.dense import dense_top
from corvane.operators.lexical import top
from corvane.operators.membership import missing_members
from corvane.operators.postings import idf, sparse_top
from corvane.schemas import FILTER
from corvane.sources.index import PointIndex
from corvane.sources.scratch import written

#: Columns of a request that may be left out, and what they are then.
_OPTIONAL = {"document_ids": ("array<string>", None), "document_version": ("int", None), "created_from": ("timestamp", None), "created_to": ("timestamp", None), "limit": ("int", 10), "max_candidates": ("int", 50), "dense": ("array<double>", None), "sparse": ("array<struct<idx:bigint,weight:double>>", None)}


@dataclass(frozen=True)
class Options:
    """What a search may do without, and the second attempt."""

    sparse_only: bool = True  # when the dense encoder failed
    dense_only: bool = False  # when the sparse one did
    rerank: Callable[[DataFrame], DataFrame] | None = None  # (query_id, id, query, text) to (query_id, id, score, error)
    expand: Callable[[DataFrame], DataFrame] | None = None  # (query_id, text) to (query_id, variant_id, dense, sparse)
    chars: int = ranking.TEXT_CHARS
    full_table: bool = True


def word_overlap(candidates: DataFrame) -> DataFrame:
    """A reranker that never fails: the overlap of the query's words with the text's."""
    from corvane.functions import text as X

    score = ranking.jaccard(X.lower_words(F.col("query")), X.lower_words(F.col("text")))
    return candidates.select("query_id", "id", score.alias("score"), F.lit(None).cast("string").alias("error"))


def checked(requests: DataFrame, known: DataFrame | None, options: Options) -> DataFrame:
    """requests with all columns and status: null where a search can go on, else why it can't.

    known: (document_id) of all documents; a request that names one that isn't there is refused, whatever else it names.
    """
    whole = requests
    for name, (kind, value) in _OPTIONAL.items():
        whole = whole.withColumn(name, (F.col(name) if name in requests.columns else F.lit(value)).cast(kind))
    no_terms = F.col("sparse").isNull() | (F.size("sparse") == 0)
    vectors = F.when(F.col("dense").isNull() & no_terms, "EMBEDDING_UNAVAILABLE").when(no_terms & F.lit(not options.dense_only), "SPARSE_UNAVAILABLE").when(F.col("dense").isNull() & F.lit(not options.sparse_only), "DENSE_UNAVAILABLE")
    status = F.coalesce(request_error(F.col("text"), F.col("limit"), F.col("max_candidates")), vectors)
    if known is not None:
        named = whole.select("query_id", F.explode("document_ids").alias("document_id"))
        lost = missing_members(named, known, "document_id").select("query_id").distinct().withColumn("_lost", F.lit(True))
        whole = whole.join(lost, "query_id", "left")
        status = F.coalesce(request_error(F.col("text"), F.col("limit"), F.col("max_candidates")), F.when(F.col("_lost"), "UNKNOWN_DOCUMENT"), vectors)
    return whole.withColumn("status", status).drop("_lost")


def _lists(index: PointIndex, asked: DataFrame, live: DataFrame, version: int, most: int) -> list[DataFrame]:
    """(dense list, sparse list) of requests or variants (query_id, dense, sparse, k, filter) over the live points of the version."""
    about = F.struct("document_id", "document_version", F.unix_micros("created_at").alias("created_at"))
    state = index.state()
    dense = dense_top(live.select("id", "dense", "document_id", "document_version", "created_at"), asked.select("query_id", F.col("dense"), "k", "filter"), most, id="id", vector="dense", about=about)
    posted, sparse = index.postings(version), asked.select("query_id", "sparse", "k", "filter")
    if state["weighting"] == "idf":
        each = sparse.select("query_id", F.inline("sparse").alias("idx", "weight"))
        weighed = each.join(F.broadcast(idf(posted, each.select("idx").distinct(), live.count())), "idx")  # a vocabulary at most
        vectors = weighed.groupBy("query_id").agg(F.collect_list(F.struct("idx", (F.col("weight") * F.col("factor")).alias("weight"))).alias("sparse"))
        sparse = sparse.drop("sparse").join(vectors, "query_id", "left")
    found = sparse_top(live.select("id", "ord", "bucket", about.alias("about")), posted, sparse, most, state["shards"])
    return [dense, found]


def _final(candidates: DataFrame, requests: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(ranked (query_id, id, score, rank), reranked (query_id) of the requests whose reranking came through). Where it failed, or there is none, the fused order stays."""
    plain = candidates.select("query_id", "id", "score", "rank")
    none = requests.where("false").select("query_id")
    if options.rerank is None:
        return plain.join(requests.select("query_id", "limit"), "query_id").where("rank <= limit").drop("limit"), none
    told = written(options.rerank(candidates.select("query_id", "id", "query", ranking.X.bounded(F.col("text"), options.chars).alias("text"))), "reranked")
    failed = told.where("error is not null").select("query_id").distinct()
    good = told.join(failed, "query_id", "left_anti")
    done = good.select("query_id").distinct()
    own = good.where("score is not null").join(plain.select("query_id", "id"), ["query_id", "id"], "left_semi")  # ids that weren't sent don't count
    both = top(own, 1 << 30, id="id").unionByName(plain.join(done, "query_id", "left_anti"))
    return both.join(requests.select("query_id", "limit"), "query_id").where("rank <= limit").drop("limit"), done


def _candidates(lists: list[DataFrame], asked: DataFrame, texts: DataFrame) -> DataFrame:
    fused = ranking.fuse(lists, id="id").join(asked.select("query_id", F.col("text").alias("query"), "max_candidates"), "query_id").where("rank <= max_candidates")
    return written(fused.select("query_id", "id", "score", "rank", "query").join(texts, "id"), "candidates")


def search_index(index: PointIndex, requests: DataFrame, known: DataFrame | None = None, excluded: DataFrame | None = None, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(results, meta) of requests (query_id, text[, dense][, sparse][, filters][, limit][, max_candidates]) over the index's active version.

    known: (document_id) of all documents, to refuse requests that name others. excluded: (document_id) that nobody may find.
    Results: query_id, source_id, id, document_id, filename, text, section_path, page_from, page_to, score, rank, index_version. Meta: a row for each request.
    """
    version = index.state()["active"]
    asked = written(checked(requests, known, options), "requests")
    good = asked.where("status is null").select("query_id", "text", "dense", "sparse", "limit", "max_candidates", F.col("max_candidates").alias("k"), F.struct("document_ids", "document_version", *(F.unix_micros(c).alias(c) for c in ("created_from", "created_to"))).cast(FILTER).alias("filter"))
    live = index.placed(version)
    if excluded is not None:
        live = without(live, excluded, "document_id")
    lists = [written(x, name) for x, name in zip(_lists(index, good, live, version, 0), ("dense", "sparse"), strict=True)]
    texts = live.select("id", "text")
    ranked, reranked = _final(_candidates(lists, good, texts), good, options)
    ranked = written(ranked, "ranked")
    expanded = good.where("false").select("query_id")
    if options.expand is not None:
        best = ranked.join(reranked.withColumn("_r", F.lit(True)), "query_id", "left").groupBy("query_id").agg(F.max(F.when(F.col("_r"), F.col("score"))).alias("best"), F.count("*").alias("n"), F.first("_r").alias("_r"))
        state = good.join(best, "query_id", "left")
        wanted = written(state.where(ranking.needs_expansion(F.coalesce("n", F.lit(0)), F.coalesce("_r", F.lit(False)), F.col("best"))).select(*good.columns), "wanted")
        variants = written(options.expand(wanted.select("query_id", "text")), "variants")
        more = _variant_lists(index, variants, wanted, live, version)
        expanded = more[0].select("query_id").union(more[1].select("query_id")).distinct()
        again, reranked_again = _final(_candidates([x.join(expanded, "query_id", "left_semi") for x in lists] + more, wanted, texts), wanted, options)
        ranked = ranked.join(expanded, "query_id", "left_anti").unionByName(again)
        reranked = reranked.join(expanded, "query_id", "left_anti").unionByName(reranked_again)
    payload = live.select("id", "document_id", "filename", "text", "table_markdown", "section_path", "page_from", "page_to", "index_version")
    shown = ranked.join(payload, "id")
    text = F.coalesce(F.when(F.col("table_markdown") != "", F.col("table_markdown")), F.col("text")) if options.full_table else F.col("text")
    results = shown.select("query_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"), "id", "document_id", "filename", ranking.X.bounded(text, options.chars).alias("text"), "section_path", "page_from", "page_to", "score", "rank", "index_version")
    return results, _meta(asked, lists, ranked, reranked, expanded)


def _variant_lists(index: PointIndex, variants: DataFrame, wanted: DataFrame, live: DataFrame, version: int) -> list[DataFrame]:
    """The variants' lists, each variant's rows counted for its request. A variant without vectors has none, and is passed over."""
    keyed = variants.join(wanted.select("query_id", "k", "filter"), "query_id").select(F.col("variant_id").alias("query_id"), "dense", "sparse", "k", "filter")
    names = variants.select(F.col("query_id").alias("_q"), F.col("variant_id").alias("_v"))
    return [written(x.withColumnRenamed("query_id", "_v").join(names, "_v").select(F.col("_q").alias("query_id"), "id", "rank"), "variant") for x in _lists(index, keyed, live, version, 0)]


def _meta(asked: DataFrame, lists: list[DataFrame], ranked: DataFrame, reranked: DataFrame, expanded: DataFrame) -> DataFrame:
    rows = asked.select("query_id", "status", F.col("dense").isNotNull().alias("dense_available"), F.col("sparse").isNotNull().alias("sparse_available"))
    for part, n, best in (*zip(lists, ("dense_candidates", "sparse_candidates"), ("top_dense_score", "_s"), strict=True), (ranked, "n_results", "_best")):
        rows = rows.join(part.groupBy("query_id").agg(F.count("*").alias(n), F.max("score").alias(best)), "query_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    for part, name in ((reranked, "reranked"), (expanded, "expanded")):
        rows = rows.join(part.select("query_id", F.lit(True).alias(name)).distinct(), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = rows.withColumn("top_rerank_score", F.when(F.col("reranked"), F.col("_best")))
    low = F.when(F.col("status").isNull(), ranking.low_confidence(F.col("top_rerank_score"), F.col("top_dense_score"), F.col("dense_available")))
    return rows.select("query_id", F.coalesce("status", F.lit("OK")).alias("status"), "dense_available", "sparse_available", "dense_candidates", "sparse_candidates", "n_results", "reranked", "expanded", "top_dense_score", "top_rerank_score", low.alias("low_confidence"))


def encoded(rows: DataFrame, dense: Column | None, sparse: Column | None) -> DataFrame:
    """Requests with their vectors, where the encoders are columns over them."""
    return rows.withColumn("dense", F.lit(None).cast("array<double>") if dense is None else dense).withColumn("sparse", F.lit(None).cast("array<struct<idx:bigint,weight:double>>") if sparse is None else sparse)
