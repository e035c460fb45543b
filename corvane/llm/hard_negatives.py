"""Hard negatives by exact integer products, with early discards in the space of the principal components.

Vectors are quantised to integers. The mean of their outer products over all rows gives an orthogonal rotation whose leading
components carry most of the products. Anchors and rows are cut into blocks, and every block of anchors meets every block of rows, which is the
stated set of queries against all rows. In such a pair of blocks the products of the leading components are accumulated group by group;
after each group the remainder of a pair of vectors lies within the product of their residual norms, and a slack for rounding.
Pairs that can't be among an anchor's first rows any more are discarded. The survivors' scores are products of integers, so the result is exact.

Two passes: an anchor's positives (its first rows of its own label), then for each positive the first rows of other labels
whose scores lie in the window that the positive's score gives. From a pair of blocks only so many rows go on as may be
returned in the end, and these are ranked by a window whose groups are limited before the shuffle.

Odd input: rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count as padded with
zeros. Rows are told apart by number, so that rows that share an id are rows of their own; null ids come after all
others in ties, and are no anchors. A row takes no part either if a quantised component is so large that its product with another such
one may not fit in 64 bits (at 64 components beyond 3.7e8, which is 1.4 million before scaling by 256). Empty tables give no rows, and so do anchors without
positives or without rows in the window. Columns beside the id, vector and label aren't read. The vectors' length is
expected to be some thousands at most, as its square is held in memory.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches, numbered, written

#: Vectors in a block of rows and of anchors, and anchors whose products with a block are in memory at once.
ROWS, ANCHORS, TILE = 4096, 2048, 128
#: Shares of the components after which pairs are discarded.
CUTS = (0.125, 0.25, 0.5)
#: Sums of integers below this are exact in doubles.
EXACT = float(1 << 52)
#: Thresholds of so many blocks of anchors are remembered by a task.
REMEMBERED = 64


def finite(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def quantised(rows: DataFrame, id: Column, vector: Column, label: Column, scale: float) -> tuple[DataFrame, int]:
    """(a written table (row, id, label, q) of the rows that take part, the vectors' length). q: floors of the scaled components, as doubles."""
    floors = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    whole = rows.select(id.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("v")).where(F.col("label").isNotNull() & finite(F.col("v")))
    table = numbered(whole.select("id", "label", floors.alias("q")), "row")
    dims = table.agg(F.max(F.size("q"))).first()[0] or 1
    most = float(isqrt(((1 << 63) - 1) // max(1, dims)))
    return table.where(~F.exists("q", lambda x: F.abs(x) > most)), max(1, dims)


def rotation(table: DataFrame, dims: int) -> np.ndarray:
    """(dims, dims), orthogonal: columns are the principal axes of all vectors, the heaviest first. dims ** 2 sums come to the driver."""
    fields = T.StructType.fromDDL("at int, total double")

    def make():
        total = np.zeros((dims, dims))

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            total[:] += (q := _padded(batch.column(0).to_pylist(), dims)).T @ q
            return iter(())

        work.finish = lambda: [{"at": list(range(dims * dims)), "total": total.ravel().tolist()}]
        return work

    moment = np.zeros(dims * dims)
    for r in map_batches(table.select("q"), make, fields).groupBy("at").agg(F.sum("total").alias("total")).collect():
        moment[r["at"]] = r["total"]
    moment = moment.reshape(dims, dims)
    return np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1].copy()


def _padded(vectors: list[list[float]], dims: int) -> np.ndarray:
    q = np.zeros((len(vectors), dims))
    for at, v in enumerate(vectors):
        q[at, : len(v)] = v
    return q


# --- blocks ---


def _blocks(table: DataFrame, size: int, dims: int, prefix: str) -> DataFrame:
    """A written row for each block of so many rows of a table (row, id, label, q[, positives]); columns begin with the prefix."""
    kinds = {f.name: f.dataType for f in table.schema}
    carried = [c for c in ("positives",) if c in kinds]
    fields = T.StructType.fromDDL("n int, rows binary, ids array<bigint>, labels binary, q binary")
    for c in carried:
        fields = fields.add(c, T.ArrayType(kinds[c]))

    def make():
        held: list[dict] = []

        def packed(rows: list[dict]) -> dict:
            longs = {c: np.array([r[c] for r in rows], dtype=np.int64).tobytes() for c in ("row", "label")}
            return {"n": [len(rows)], "rows": [longs["row"]], "ids": [[r["id"] for r in rows]], "labels": [longs["label"]], "q": [_padded([r["q"] for r in rows], dims).tobytes()]} | {c: [[r[c] for r in rows]] for c in carried}

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            held.extend(batch.to_pylist())
            while len(held) >= size:
                yield packed(held[:size])
                del held[:size]

        work.finish = lambda: [packed(held)] if held else []
        return work

    found = written(map_batches(table, make, fields).withColumn("block", F.monotonically_increasing_id()), "vectors")
    return found.select(*(F.col(c).alias(prefix + c) for c in found.columns))


class Vectors:
    """A block's vectors: integers, and rotated with the norms of what is left after each cut."""

    def __init__(self, row: dict, prefix: str, axes: np.ndarray, cuts: list[int]):
        self.rows, self.labels = (np.frombuffer(row[prefix + c], dtype=np.int64) for c in ("rows", "labels"))
        ids = row[prefix + "ids"]
        self.ids, self.null = np.array([x or 0 for x in ids], dtype=np.int64), np.array([x is None for x in ids], dtype=bool)
        self.q = np.frombuffer(row[prefix + "q"], dtype=np.float64).reshape(row[prefix + "n"], len(axes))
        self.turned = self.q @ axes
        squares = self.turned**2
        self.left = [np.sqrt(squares[:, c:].sum(axis=1)) for c in cuts]
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.largest = float(np.abs(self.q).max(initial=0))

    def names(self, at: np.ndarray) -> list:
        return [None if n else int(x) for x, n in zip(self.ids[at], self.null[at], strict=True)]


def products(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer products of pairs of vectors, as 64-bit integers."""
    exact = a.largest * b.largest * a.q.shape[1] < EXACT  # then doubles are as good as integers
    kind = np.float64 if exact else np.int64
    out = np.zeros(len(i), dtype=np.int64)
    for s in range(0, len(i), 65536):
        out[s : s + 65536] = np.einsum("ij,ij->i", a.q[i[s : s + 65536]].astype(kind), b.q[j[s : s + 65536]].astype(kind))
    return out


def survivors(a: Vectors, b: Vectors, cuts: list[int], mine: slice, alive: np.ndarray, floor: np.ndarray, roof: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, integer product) of the anchors `mine` and b's rows that are alive, where the product is from the anchor's floor to its roof.

    After each cut the pairs are discarded whose bounds lie outside. While many are left, products of all with all are quicker than those of single pairs.
    """
    dims = a.q.shape[1]
    rounding = (8.0 * dims**1.5 + 64) * np.finfo(np.float64).eps  # the rotation's error and that of sums of dims products, relative to the norms
    part, done, pairs = np.zeros(alive.shape), 0, None
    for at, cut in enumerate(cuts):
        left_a, left_b = a.left[at][mine], b.left[at]
        if pairs is None:
            part += a.turned[mine, done:cut] @ b.turned[:, done:cut].T
            rest = np.outer(left_a, left_b) + np.outer(rounding * a.norm[mine], b.norm)
            alive = alive & (part + rest >= floor[:, None])
            if roof is not None:
                alive &= part - rest <= roof[:, None]
            if np.count_nonzero(alive) * 8 < alive.size:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            i, j = pairs
            part += np.einsum("ij,ij->i", a.turned[mine.start + i, done:cut], b.turned[j, done:cut])
            rest = left_a[i] * left_b[j] + rounding * a.norm[mine.start + i] * b.norm[j]
            stay = part + rest >= floor[i]
            if roof is not None:
                stay &= part - rest <= roof[i]
            pairs, part = (i[stay], j[stay]), part[stay]
        done = cut
    if pairs is None and a.largest * b.largest * dims < EXACT:
        whole = a.q[mine] @ b.q.T  # exact, in whatever order it is summed
        alive = alive & (whole >= floor[:, None])
        if roof is not None:
            alive &= whole <= roof[:, None]
        i, j = np.nonzero(alive)
        return mine.start + i, j, whole[i, j].astype(np.int64)
    i, j = np.nonzero(alive) if pairs is None else pairs
    score = products(a, b, mine.start + i, j)
    fit = score >= floor[i]
    if roof is not None:
        fit &= score <= roof[i]
    return mine.start + i[fit], j[fit], score[fit]


def first(b: Vectors, i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first k pairs of each anchor, places of the k-th): higher scores, then smaller ids with null last, then smaller rows."""
    order = np.lexsort((b.rows[j], b.ids[j], b.null[j], -score, i))
    starts = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0]) if len(i) else np.zeros(0, int)
    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    return order[place < k], order[place == k - 1]


class Remembered(OrderedDict):
    """What a task knows of the last blocks of anchors: scores that a row must reach to be returned."""

    def of(self, block: int, shape: tuple[int, ...]) -> np.ndarray:
        if block not in self:
            self[block] = np.full(shape, -np.inf)
            while len(self) > REMEMBERED:
                self.popitem(last=False)
        self.move_to_end(block)
        return self[block]


def _tiles(n: int) -> Iterator[slice]:
    return (slice(s, min(s + TILE, n)) for s in range(0, n, TILE))


def _best_rows(a: Vectors, b: Vectors, cuts: list[int], least: np.ndarray, k: int) -> Iterator[dict]:
    """Each anchor's first k other rows of its label in a block."""
    for mine in _tiles(len(a.q)):
        same = (a.labels[mine, None] == b.labels) & (a.rows[mine, None] != b.rows)
        i, j, score = survivors(a, b, cuts, mine, same, least[mine])
        best, last = first(b, i, j, score, k)
        least[i[last]] = np.maximum(least[i[last]], np.nextafter(score[last].astype(np.float64), -np.inf))
        i, j = i[best], j[best]
        yield {"a_row": a.rows[i].tolist(), "a_id": a.names(i), "row": b.rows[j].tolist(), "id": b.names(j), "score": score[best].tolist()}


def _rows_in_windows(a: Vectors, b: Vectors, cuts: list[int], least: np.ndarray, k: int, given: list[list[dict]], shares: tuple[int, int]) -> Iterator[dict]:
    """For each positive of each anchor, the first k rows of other labels in a block whose scores lie in the positive's window.

    An anchor's windows overlap, so pairs are kept that may lie between the lowest end, or score to reach, and the highest end; then each window takes its own.
    """
    most = least.shape[1]
    low_end, high_end = np.full(least.shape, (1 << 63) - 1, dtype=np.int64), np.full(least.shape, -(1 << 63), dtype=np.int64)
    for x, positives in enumerate(given):
        for y, p in enumerate(positives):  # Python's integers, as 100 times a score may not fit in 64 bits
            low_end[x, y], high_end[x, y] = -(-shares[0] * p["score"] // 100), shares[1] * p["score"] // 100
    # doubles, rounded outwards
    lowest, roof = np.nextafter(low_end.astype(np.float64), -np.inf), np.nextafter(high_end.max(axis=1).astype(np.float64), np.inf)
    for mine in _tiles(len(a.q)):
        floor = np.where(low_end[mine] <= high_end[mine], np.maximum(lowest[mine], least[mine]), np.inf).min(axis=1)
        i, j, score = survivors(a, b, cuts, mine, a.labels[mine, None] != b.labels, floor, roof[mine])
        for y in range(most):
            inside = np.flatnonzero((score >= low_end[i, y]) & (score <= high_end[i, y]) & (score >= least[i, y]))
            best, last = first(b, i[inside], j[inside], score[inside], k)
            best, last = inside[best], inside[last]
            least[i[last], y] = np.maximum(least[i[last], y], np.nextafter(score[last].astype(np.float64), -np.inf))
            u, v = i[best], j[best]
            p = [given[x][y] for x in u]
            yield {"a_row": a.rows[u].tolist(), "a_id": a.names(u), "p_row": [x["row"] for x in p], "p_id": [x["id"] for x in p], "p_score": [x["score"] for x in p], "row": b.rows[v].tolist(), "id": b.names(v), "score": score[best].tolist()}


def _against(blocks: DataFrame, anchors: DataFrame, axes: np.ndarray, cuts: list[int], fields: str, found) -> DataFrame:
    """found(a, b, row, known) over each pair of a block of anchors and a block of rows: the stated queries against all rows. A pair of blocks is a row of a few MB."""

    def make():
        known = Remembered()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield from found(Vectors(row, "a_", axes, cuts), Vectors(row, "b_", axes, cuts), row, known)

        return work

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(blocks.repartition(parts, "b_block").crossJoin(anchors), make, T.StructType.fromDDL(fields))


def hard_negatives(rows: DataFrame, anchor: Column, id: Column, vector: Column, label: Column, scale: float = 256, positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, over rows of a table.

    anchor: over `id`, whether a row is an anchor. A score is the product of quantised vectors (floors of `scale` times a component). An anchor's positives
    are its first other rows of the same label; its negatives for a positive the first rows of other labels whose scores are from
    shares[0] to shares[1] percent of the positive's. Odd input: see the module.
    """
    table, dims = quantised(rows, id, vector, label, scale)
    axes = rotation(table, dims)
    cuts = sorted({max(1, int(dims * c)) for c in CUTS})
    blocks = _blocks(table, ROWS, dims, "b_")
    anchors = table.where(F.coalesce(anchor, F.lit(False)))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]

    def best(a, b, row, known):
        return _best_rows(a, b, cuts, known.of(row["a_block"], (len(a.q),)), positives)

    pairs = _against(blocks, _blocks(anchors, ANCHORS, dims, "a_"), axes, cuts, "a_row bigint, a_id bigint, row bigint, id bigint, score bigint", best)
    place = F.row_number().over(Window.partitionBy("a_row").orderBy(*order))
    of_anchor = pairs.withColumn("place", place).where(F.col("place") <= positives).groupBy("a_row").agg(F.array_sort(F.collect_list(F.struct("place", "row", "id", "score"))).alias("positives"))
    asked = written(anchors.join(of_anchor.withColumnRenamed("a_row", "row"), "row"), "anchors")

    def windows(a, b, row, known):
        given = row["a_positives"]
        least = known.of(row["a_block"], (len(a.q), positives))
        return _rows_in_windows(a, b, cuts, least, negatives, given, shares)

    fields = "a_row bigint, a_id bigint, p_row bigint, p_id bigint, p_score bigint, row bigint, id bigint, score bigint"
    pairs = _against(blocks, _blocks(asked, ANCHORS, dims, "a_"), axes, cuts, fields, windows)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a_row", "p_row").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of embeddings (vec_id, embedding, label): anchors are every hundredth vec_id, and every seventh has its label moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("id") % 100 == 0, F.col("vec_id"), F.col("embedding"), label)


#: DuckDB SQL for mined() over the table embeddings.
SQL = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS a_r, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM good a JOIN good b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a_r ORDER BY score DESC, vec_id, r) <= 5
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a_r, p.r ORDER BY n.score DESC, n.vec_id, n.r) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.a_r = p.a_r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
