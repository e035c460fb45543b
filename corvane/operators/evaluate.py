"""Retrieval quality: ranks of first relevant units, recall and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relevant(ranked: DataFrame, gold: DataFrame, text: str = "text") -> DataFrame:
    """ranked (query_id, text, rank) rows whose text holds all of the case's needles. gold: (query_id, needles)."""
    return ranked.join(gold, "query_id").where(F.forall("needles", lambda n: F.contains(F.col(text), n))).drop("needles")


def first_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, hit_rank) of every case; null where nothing relevant was ranked. hits: (query_id, rank)."""
    return cases.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("hit_rank")), "query_id", "left")


def report(firsts: DataFrame, k: int = 10) -> DataFrame:
    """One row (n_cases, recall, mrr); zeros without cases."""
    hit = F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("double")
    return firsts.agg(F.count("*").alias("n_cases"), F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"))
