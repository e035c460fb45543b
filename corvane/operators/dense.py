"""Exact dense search: cosine top-k of a table of queries against all points, with cells of points that are skipped whole.

A bounded sample of the points gives the cells' centres. Points go to the cell of their nearest centre, and a cell's points into blocks
of at most `BLOCK`; a block has the mean direction of its points and their largest angle to it. By the triangle inequality for angles no point
of a block can be nearer to a query than the query's angle to the centre, less that radius. Queries are dealt to groups of bounded size and blocks
to a fixed number of parts; a task holds a group's queries while a part's blocks go by, and keeps the k best of each query. Where a block's bound is under the query's k-th
best so far (at first what the sample alone gives), the block is skipped for the query; else it is scored as a product of matrices. So queries are sent once for each part, blocks once
for each group, and a part returns k rows for each query at most. The sample only decides how much is skipped, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions import vectors as V
from corvane.operators.lexical import top
from corvane.schemas import ABOUT, FILTER

#: Numbers in the sample of points at most, cells at most, points and queries in a block.
SAMPLE, CELLS, BLOCK, ASKED = 1 << 21, 256, 1024, 256
#: Parts that the points are dealt to, numbers in the vectors of a group of queries, and candidates that a task holds before it cuts them.
PARTS, GROUP, HELD = 32, 1 << 20, 1 << 20
#: More than rounding changes in a score of unit vectors.
SLACK = 1e-8


def unit(points: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) as unit vectors in double."""
    return points.select(id, V.l2_normalize(V.doubles(F.col(vector))).alias("v"))


def passes(asked: dict | None, about: list[dict]) -> np.ndarray:
    """Which points pass a query's filter: the documents asked for (none named: all), their version, the moment of their making."""
    fine = np.ones(len(about), dtype=bool)
    if not asked:
        return fine
    if asked["document_ids"]:
        wanted = asked["document_ids"]
        wanted = wanted if isinstance(wanted, frozenset) else set(wanted)
        fine &= np.fromiter((a["document_id"] in wanted for a in about), dtype=bool, count=len(about))
    if asked["document_version"] is not None:
        fine &= np.fromiter((a["document_version"] == asked["document_version"] for a in about), dtype=bool, count=len(about))
    if asked["created_from"] is not None or asked["created_to"] is not None:
        low, high = asked["created_from"], asked["created_to"]
        fine &= np.fromiter((a["created_at"] is not None and (low is None or a["created_at"] >= low) and (high is None or a["created_at"] <= high) for a in about), dtype=bool, count=len(about))
    return fine


def _units(vectors: list[list[float]]) -> np.ndarray:
    v = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def _mapped(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], fields: T.StructType, step: int = BLOCK) -> DataFrame:
    """work over a task's rows as dicts, `step` at a time."""
    target = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield from batch.slice(at, step).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in work(rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, fields)


def centres(sample: np.ndarray, most: int = CELLS) -> np.ndarray:
    """Directions that a sample of unit vectors gathers around: a few rounds of spherical k-means, from rows spread over the sample."""
    k = max(1, min(most, int(np.sqrt(len(sample)))))
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(6):
        mine = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, mine, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.where(norms == 0, 1, norms), found)
    return found


def sampled(points: DataFrame, vector: str, extra: list[Column]) -> tuple[np.ndarray, list[dict]]:
    """Unit vectors of a bounded sample of the points (SAMPLE numbers at most, drawn by hash), and what filters are held against."""
    points = points.where(F.col(vector).isNotNull())
    n, d = points.agg(F.count("*"), F.max(F.size(vector))).first()
    if not n or not d:
        return np.zeros((0, 0)), []
    most = max(16, SAMPLE // d)
    # each row by a hash of its own, so that copies are drawn apart; rows over the bound aren't sent at all
    drawn = points if n <= most else points.where(F.pmod(F.xxhash64(F.monotonically_increasing_id(), vector), F.lit(1 << 30)) < int((1 << 30) * most / n))
    rows = drawn.select(V.doubles(F.col(vector)).alias("v"), *extra).collect()
    return _units([r["v"] for r in rows]) if rows else np.zeros((0, d)), [r["about"].asDict() if r["about"] else None for r in rows]


def cells(points: DataFrame, id: str, vector: str, around: np.ndarray, about: Column) -> DataFrame:
    """Blocks of points of one cell: (block, ids, about, v, centre, radius). A cell's points may be in many blocks and tasks."""
    kind = points.schema[id].dataType
    flat = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", kind), T.StructField("about", ABOUT), T.StructField("v", T.ArrayType(T.DoubleType()))])
    out = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("about", T.ArrayType(ABOUT)), T.StructField("v", T.BinaryType()), T.StructField("centre", T.BinaryType()), T.StructField("radius", T.DoubleType())])

    def place(rows: Iterator[dict]) -> Iterator[dict]:
        for some in _runs(rows, lambda r: None):
            v = _units([r["v"] for r in some])
            yield {"cell": np.argmax(v @ around.T, axis=1).astype(np.int32), "id": [r["id"] for r in some], "about": [r["about"] for r in some], "v": list(v)}

    def pack(rows: Iterator[dict]) -> Iterator[dict]:
        for some in _runs(rows, lambda r: r["cell"]):
            v = np.array([r["v"] for r in some])
            mean = _units([v.sum(axis=0)])
            cosines = v @ mean[0]
            odd = not mean.any() or (np.linalg.norm(v, axis=1) < 0.5).any()  # no direction: never skipped
            yield {"ids": [[r["id"] for r in some]], "about": [[r["about"] for r in some]], "v": [v.tobytes()], "centre": [mean.tobytes()], "radius": [np.pi if odd else float(np.arccos(np.clip(cosines.min(), -1, 1)))]}

    placed = _mapped(points.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), about.alias("about"), V.doubles(F.col(vector)).alias("v")), place, flat)
    salt = F.pmod(F.xxhash64("id"), F.lit(64))  # a cell that holds much of all points goes to many tasks
    packed = _mapped(placed.repartition("cell", salt).sortWithinPartitions("cell"), pack, out)
    return packed


def _runs(rows: Iterator[dict], key: Callable[[dict], object]) -> Iterator[list[dict]]:
    """Neighbours with the same key, BLOCK at most."""
    held: list[dict] = []
    for row in rows:
        if held and (len(held) >= BLOCK or key(row) != key(held[0])):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def dense_top(points: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", about: Column | None = None) -> DataFrame:
    """The k nearest points of each query (query_id, vector[, k][, filter]) by cosine: (query_id, id, score, rank).

    A query's own k, if there, holds instead; its filter is held against `about`, a struct of what ABOUT names. Points and queries
    without a vector are passed over; a vector of zeros has the score 0.
    """
    query_kind, id_kind = queries.schema["query_id"].dataType, points.schema[id].dataType
    told = F.lit(None).cast(ABOUT) if about is None else about.cast(ABOUT)
    sample, sample_about = sampled(points, vector, [told.alias("about")])
    if not sample.shape[1]:
        return points.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", query_kind), T.StructField(id, id_kind)]).add("score", "double").add("rank", "long"))
    own_k = F.col("k").cast("int") if "k" in queries.columns else F.lit(k)
    own_filter = F.col("filter").cast(FILTER) if "filter" in queries.columns else F.lit(None).cast(FILTER)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").alias("q"), own_k.alias("k"), own_filter.alias("filter"), V.doubles(F.col(vector)).alias("v"))
    listed = T.StructType([T.StructField("q", T.ArrayType(query_kind)), T.StructField("k", T.ArrayType(T.IntegerType())), T.StructField("filter", T.ArrayType(FILTER)), T.StructField("v", T.BinaryType()), T.StructField("least", T.ArrayType(T.DoubleType()))])

    def ask(rows: Iterator[dict]) -> Iterator[dict]:
        """Queries in blocks, with the score that the k-th best of the sample has."""
        held: list[dict] = []

        def block(some: list[dict]) -> dict:
            v = _units([r["v"] for r in some])
            scores, least = v @ sample.T, []
            for s, r in zip(scores, some, strict=True):
                fit = s[passes(r["filter"], sample_about)] if r["filter"] else s
                least.append(float(np.partition(fit, -r["k"])[-r["k"]]) if 0 < r["k"] <= len(fit) else -2.0)
            return {"q": [[r["q"] for r in some]], "k": [[r["k"] for r in some]], "filter": [[r["filter"] for r in some]], "v": [v.tobytes()], "least": [least]}

        for row in rows:
            held.append(row)
            if len(held) == ASKED:
                yield block(held)
                held = []
        if held:
            yield block(held)

    def score(rows: Iterator[dict]) -> Iterator[dict]:
        """The best of each part's points for each group's queries: a group's queries come first, then the blocks one after the other."""
        packs, best, key = [], None, None
        for r in rows:
            if (r["group"], r["part"]) != key:
                if best:
                    yield from best.told(id)
                packs, best, key = [], None, (r["group"], r["part"])
            if r["ids"] is None:
                packs.append(r)
            elif packs:
                best = best or Best(packs, isinstance(id_kind, T.IntegralType))
                best.meet(r)
        if best:
            yield from best.told(id)

    packs = _mapped(asked, ask, listed)
    groups = max(1, -(-queries.count() // max(1, GROUP // sample.shape[1])))
    number = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = points.sparkSession.range(PARTS).select(F.col("id").cast("int").alias("part"))
    blocks = cells(points, id, vector, centres(sample) if len(sample) else np.eye(1, sample.shape[1]), told).withColumn("part", number(PARTS)).withColumn("group", each(groups))
    both = blocks.withColumnRenamed("v", "points").unionByName(packs.withColumn("group", number(groups)).crossJoin(F.broadcast(parts)), allowMissingColumns=True)
    dealt = both.repartition(groups * PARTS, "group", "part").sortWithinPartitions("group", "part", F.col("ids").isNotNull())
    scored = _mapped(dealt, score, T.StructType([T.StructField("query_id", query_kind), T.StructField(id, id_kind), T.StructField("score", T.DoubleType())]), 8)
    if "k" in queries.columns:
        ranked = top(scored, queries.agg(F.max("k")).first()[0] or 0, id=id)
        return ranked.join(queries.select("query_id", F.col("k").alias("_k")), "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")
    return top(scored, k, id=id)


class Best:
    """The k best points so far of each query of a group, while blocks of points go by."""

    def __init__(self, packs: list[dict], whole: bool):
        self._keep([x for r in packs for x in r["q"]], np.array([x for r in packs for x in r["k"]]), np.array([x for r in packs for x in r["least"]]), whole)
        self.filter = [_ready(x) for r in packs for x in r["filter"]]
        self.v = np.concatenate([np.frombuffer(r["v"]).reshape(len(r["q"]), -1) for r in packs])
        self.flat = ~self.v.any(axis=1)
        self.picky = np.array([x is not None for x in self.filter])

    def _keep(self, q: list, k: np.ndarray, least: np.ndarray, whole: bool) -> None:
        """Queries, how many points each wants and what score they have to reach; nothing is held yet."""
        self.q, self.k, self.least = q, k, least
        self.kind = np.int64 if whole else object
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0
        self.most = HELD

    def meet(self, block: dict) -> None:
        centre, ids = np.frombuffer(block["centre"]), np.array(block["ids"], dtype=self.kind)
        points = np.frombuffer(block["points"]).reshape(len(ids), -1)
        angles = np.arccos(np.clip(self.v @ centre, -1, 1))
        bound = np.where(self.flat | (block["radius"] >= np.pi), 2.0, np.cos(np.maximum(0.0, angles - block["radius"])))
        near = np.flatnonzero((bound >= self.least - SLACK) & (self.k > 0))
        for at in range(0, len(near), ASKED):
            some = near[at : at + ASKED]
            scores = np.round(self.v[some] @ points.T, 9)
            fit = scores >= (self.least[some] - SLACK)[:, None]
            for i in np.flatnonzero(self.picky[some] & fit.any(axis=1)):
                fit[i] &= passes(self.filter[some[i]], block["about"])
            own, place = np.nonzero(fit)
            self.held.append((some[own].astype(np.int32), scores[own, place], ids[place]))
            self.n += len(own)
            if self.n > self.most:
                self._cut()

    def _cut(self) -> None:
        """Only the k best of each query, by score and then id, stay; the k-th is what others have to reach from here on."""
        if not self.held:
            return
        q, score, ids = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k[q] - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        keep = rank < self.k[q]
        self.held, self.n = [(q[keep], score[keep], ids[keep])], int(keep.sum())
        self.most = max(HELD, 2 * self.n)

    def told(self, id: str) -> Iterator[dict]:
        self._cut()
        for q, score, ids in self.held:
            for at in range(0, len(q), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield {"query_id": [self.q[i] for i in q[part]], id: ids[part].tolist(), "score": score[part].tolist()}


def _ready(asked: dict | None) -> dict | None:
    """A filter whose documents are a set, made once; None where it asks for nothing."""
    if not asked or not any(x is not None for x in asked.values()):
        return None
    return asked | {"document_ids": frozenset(asked["document_ids"] or ())}
