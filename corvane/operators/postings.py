"""Top-k over stored postings: sparse dot products of queries with the points of an index version, without their texts.

A bucket of the index holds the blocks of postings of its points, so a common term is spread over all buckets. The terms that are asked for
(a vocabulary at most) are broadcast, and with them the shards that are read. A bucket then meets a block of queries in one task: terms
are taken by the most they can add; as soon as a query's k-th best beats what the terms that are left can add together,
only points that are in reach are looked up, in the blocks that hold them, and a block whose largest weight isn't enough for any of its points is passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.operators.dense import passes
from corvane.operators.lexical import top
from corvane.schemas import ABOUT, FILTER

#: Queries that a task answers together.
TOGETHER = 512
#: More than rounding changes in a score, which is ranked on nine places.
SLACK = 1e-7


class Bucket:
    """The points and postings of a bucket. looked counts the blocks that queries read."""

    def __init__(self, points: list[dict], blocks: list[dict]):
        self.n = 1 + max((p["ord"] for p in points), default=-1)
        self.ids: list = [None] * self.n
        self.about: list = [None] * self.n
        self.live = np.zeros(self.n, dtype=bool)
        for p in points:
            self.ids[p["ord"]], self.about[p["ord"]], self.live[p["ord"]] = p["id"], p["about"], True
        self.terms: dict[int, list[tuple[float, np.ndarray, np.ndarray]]] = {}
        for b in sorted(blocks, key=lambda b: (b["idx"], b["block"])):
            ords = np.array(b["ords"], dtype=np.int64)
            fit = ords < self.n  # points after the last live one
            if fit.any():
                self.terms.setdefault(b["idx"], []).append((b["best"], ords[fit], np.array(b["weights"])[fit]))
        self.looked = 0

    def allowed(self, wanted: dict | None) -> np.ndarray:
        if not wanted:
            return self.live
        there = np.flatnonzero(self.live)
        fine = np.zeros(self.n, dtype=bool)
        fine[there[passes(wanted, [self.about[i] for i in there])]] = True
        return fine

    def best(self, asked: list[tuple[int, float]], k: int, wanted: dict | None = None) -> list[tuple[int, float]]:
        """(ord, score) of the k best points, by score to nine places, then place, which is the ids' order. Weights aren't negative; only scores over 0 count."""
        terms = [(weight * max(b[0] for b in self.terms[idx]), weight, self.terms[idx]) for idx, weight in asked if weight > 0 and idx in self.terms]
        if not terms or k < 1:
            return []
        terms.sort(key=lambda t: -t[0])
        rest = np.cumsum([t[0] for t in terms][::-1])[::-1]  # what terms from here on can add at most
        allowed, total, reach = self.allowed(wanted), np.zeros(self.n), None
        for at, (_, weight, blocks) in enumerate(terms):
            after = rest[at + 1] if at + 1 < len(terms) else 0.0
            if reach is None:
                for _, ords, weights in blocks:
                    np.add.at(total, ords, weight * weights)
                    self.looked += 1
                among = np.flatnonzero(allowed & (total > 0))
            else:
                for most, ords, weights in blocks:
                    mine = reach[np.searchsorted(reach, ords[0]) : np.searchsorted(reach, ords[-1], "right")]
                    mine = mine[total[mine] + weight * most + after >= least - SLACK]
                    if not len(mine):
                        continue
                    self.looked += 1
                    place = np.searchsorted(ords, mine)
                    hit = ords[place] == mine
                    np.add.at(total, mine[hit], weight * weights[place[hit]])
                among = reach
            if len(among) >= k:
                least = np.partition(total[among], -k)[-k]
                if reach is not None or least > after:  # a point that isn't met yet can't get in any more
                    reach = among[total[among] + after >= least - SLACK]
        found = np.flatnonzero(allowed & (total > 0)) if reach is None else reach
        score = np.round(total[found], 9)
        order = np.lexsort((found, -score))[:k]
        return [(int(found[i]), float(score[i])) for i in order]


def idf(postings: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(idx, factor): inverse document frequencies of terms (idx) among n points, from the postings."""
    df = postings.join(F.broadcast(terms), "idx", "left_semi").groupBy("idx").agg(F.sum(F.size("ords")).alias("df"))
    return df.select("idx", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("factor"))


def sparse_top(points: DataFrame, postings: DataFrame, queries: DataFrame, k: int, shards: int, id: str = "id") -> DataFrame:
    """The k best points of each query by the dot product with its sparse vector: (query_id, id, score, rank).

    points: (id, ord, bucket, about) of those that may be found. postings: as the index has them. queries: (query_id, sparse[, k][, filter]) with sparse an
    array of (idx, weight); terms of weight 0 or less are passed over.
    """
    query_kind = queries.schema["query_id"].dataType
    own_k = F.col("k").cast("int") if "k" in queries.columns else F.lit(k)
    own_filter = F.col("filter").cast(FILTER) if "filter" in queries.columns else F.lit(None).cast(FILTER)
    asked = queries.where(F.col("sparse").isNotNull()).select(F.col("query_id").alias("q"), own_k.alias("k"), own_filter.alias("filter"), "sparse")
    groups = max(1, -(-asked.count() // TOGETHER))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
    each = asked.select("group", F.inline("sparse").alias("idx", "weight")).where("weight > 0")
    terms = each.select("group", "idx").distinct().withColumn("shard", F.pmod("idx", F.lit(shards)).cast("int"))
    # one group has a vocabulary of terms at most, and so is broadcast, which prunes the shards; more groups are joined as Spark sees fit
    blocks = postings.join(F.broadcast(terms) if groups == 1 else terms, ["shard", "idx"])
    buckets = points.select("bucket").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    shape = {"idx": "bigint", "block": "int", "best": "double", "ords": "array<int>", "weights": "array<double>", "id": points.schema[id].dataType, "ord": "int", "about": ABOUT, "q": query_kind, "k": "int", "filter": FILTER, "sparse": "array<struct<idx:bigint,weight:double>>"}

    def row(rows: DataFrame, *has: str) -> DataFrame:
        return rows.select("bucket", "group", *((F.col(c) if c in has else none(kind)).cast(kind).alias(c) for c, kind in shape.items()))

    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    sides = row(blocks, "idx", "block", "best", "ords", "weights").unionByName(row(points.select("bucket", F.col(id).alias("id"), "ord", "about", every), "id", "ord", "about")).unionByName(row(asked.crossJoin(F.broadcast(buckets)), "q", "k", "filter", "sparse"))  # buckets: a number that the index fixes
    fields = T.StructType([T.StructField("query_id", query_kind), T.StructField(id, points.schema[id].dataType), T.StructField("score", T.DoubleType())])
    target = to_arrow_schema(fields)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = Bucket([r for r in rows if r["ord"] is not None], [r for r in rows if r["ords"] is not None])
        out: dict[str, list] = {f.name: [] for f in target}
        for r in rows:
            if r["sparse"] is not None:
                for place, score in bucket.best([(t["idx"], t["weight"]) for t in r["sparse"]], r["k"], r["filter"]):
                    out["query_id"].append(r["q"])
                    out[id].append(bucket.ids[place])
                    out["score"].append(score)
        return pa.table([pa.array(out[f.name], f.type) for f in target], schema=target)

    scored = sides.groupBy("bucket", "group").applyInArrow(answer, fields)
    if "k" not in queries.columns:
        return top(scored, k, id=id)
    ranked = top(scored, queries.agg(F.max("k")).first()[0] or 0, id=id)
    return ranked.join(queries.select("query_id", F.col("k").alias("_k")), "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")
