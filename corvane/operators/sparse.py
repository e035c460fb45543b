"""Exact sparse search: the best points of a table of queries by dot product, where queries are many and no row is made for a pair.

Points and queries are counted where they stand and packed into blocks with a dictionary of their own terms. Queries are dealt to groups of bounded
size and points' blocks to a fixed number of parts; a task holds a group while a part's blocks go by, adds up what shared terms give, and keeps
the k best of each query. So queries are sent once for each part, blocks once for each group, and a part returns k rows for each query at most. Time grows with queries times
points by nature, shuffle and memory don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions import text as X
from corvane.functions.encoders import counted
from corvane.operators.dense import SLACK, Best
from corvane.operators.lexical import AVERAGE, saturation, top
from corvane.sources.scratch import written

#: Points in a block, and postings in a block of points and of queries, at most (but a point or query is never cut).
BLOCK, POSTINGS, ASKED = 1024, 1 << 17, 1 << 16
#: Parts that the points are dealt to, postings of a group of queries about, postings of points that are scored at once.
PARTS, GROUP, SHELF = 32, 1 << 22, 1 << 20
#: The share of a shelf's pairs that a term has from which on it is added up as a row and column of matrices, and queries that are multiplied at once.
OFTEN, AT_ONCE = 1 / 50, 256


def _counts(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, r): for each id an array of (len, c), where c counts the terms of a text of len tokens. Texts that share an id stand side by side."""
    each = rows.select(F.col(id).alias("id"), X.terms(F.col(text)).alias("t")).select("id", F.size("t").cast("long").alias("len"), counted(F.col("t"), None, T.StringType()).alias("c"))
    if rows.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return each.select("id", F.array(F.struct("len", "c")).alias("r"))
    merged = each.select("id", "len", F.inline("c")).groupBy("id", "len", "term").agg(F.sum("tf").alias("tf"))  # as if texts of one length were one
    listed = merged.groupBy("id", "len").agg(F.collect_list(F.struct("term", "tf")).alias("c"))
    return listed.groupBy("id").agg(F.collect_list(F.struct("len", "c")).alias("r"))


def _fields(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("n", T.BinaryType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("code", T.BinaryType()), T.StructField("w", T.BinaryType())])


def _packed(counts: DataFrame, kind: T.DataType, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> DataFrame:
    """Blocks of neighbours: their ids, how many postings each has, the block's terms, and each posting's term and weight."""
    target = to_arrow_schema(_fields(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column("r")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(r).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = r.flatten()
            lists = texts.field("c")
            of_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            past = np.concatenate([[0], np.cumsum(of_text)])[ends]
            length = np.repeat(texts.field("len").to_numpy(zero_copy_only=False), of_text)
            postings = lists.flatten()
            w = weigh(postings.field("tf").to_numpy(zero_copy_only=False), length).astype(np.float64)
            at = 0
            while at < batch.num_rows:
                end = min(at + BLOCK, batch.num_rows, max(at + 1, int(np.searchsorted(past, past[at] + most, "right")) - 1))
                part = slice(int(past[at]), int(past[end]))
                if part.stop > part.start:
                    coded = postings.field("term").slice(part.start, part.stop - part.start).dictionary_encode()
                    row = [batch.column("id").slice(at, end - at).to_pylist()], [np.diff(past[at : end + 1]).astype(np.int32).tobytes()], [coded.dictionary], [coded.indices.to_numpy().astype(np.int32).tobytes()], [w[part].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if f.name != "terms" else pa.ListArray.from_arrays([0, len(x[0])], x[0]).cast(f.type) for x, f in zip(row, target, strict=True)], schema=target)
                at = end

    return counts.mapInArrow(run, _fields(kind))


def sparse_top(points: DataFrame, queries: DataFrame, k: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the k best points of each query by the dot product of stored weights and query counts, as lexical.sparse_dot. Only scores over 0.

    Points without an id are passed over.
    """
    query_kind, id_kind = queries.schema["query_id"].dataType, points.schema[id].dataType
    asked = written(_packed(_counts(queries.select("query_id", "text"), "query_id", "text"), query_kind, lambda tf, length: tf, ASKED), "asked")
    total = asked.agg(F.sum(F.length("w") / 8)).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP))
    blocks = _packed(_counts(points.where(F.col(id).isNotNull()), id, text), id_kind, lambda tf, length: saturation(tf.astype(np.float64), length, AVERAGE), POSTINGS)

    number = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packs = asked.withColumnRenamed("ids", "q").withColumn("group", number(groups)).withColumn("part", each(PARTS))
    both = blocks.withColumn("part", number(PARTS)).withColumn("group", each(groups)).unionByName(packs, allowMissingColumns=True)
    dealt = both.repartition(groups * PARTS, "group", "part").sortWithinPartitions("group", "part", F.col("ids").isNotNull())
    fields = T.StructType([T.StructField("query_id", query_kind), T.StructField(id, id_kind), T.StructField("score", T.DoubleType())])
    target, whole = to_arrow_schema(fields), isinstance(id_kind, T.IntegralType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's queries come first, then the blocks one after the other."""
        packs, sums, key = [], None, None

        def told() -> Iterator[pa.RecordBatch]:
            if sums:
                for row in sums.told(id):
                    yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in target], schema=target)

        for batch in batches:
            for r in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*batch.columns, strict=True)):
                if (r["group"].as_py(), r["part"].as_py()) != key:
                    yield from told()
                    packs, sums, key = [], None, (r["group"].as_py(), r["part"].as_py())
                if not r["ids"].is_valid:
                    packs.append(r)
                elif packs:
                    sums = sums or Sums(packs, k, whole)
                    sums.meet(r)
        yield from told()

    return top(dealt.mapInArrow(run, fields), k, id=id)


def _numbers(column: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(column.as_buffer(), dtype=kind)


def _table(row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, height: int) -> np.ndarray:
    """A matrix of what adds up at each place."""
    return np.bincount(row * width + column, weights=value, minlength=height * width).reshape(height, width)


class Sums(Best):
    """The k best points so far of each query of a group, while blocks of postings go by: blocks are gathered to a shelf of bounded size, and a query meets a shelf at once."""

    def __init__(self, packs: list[dict], k: int, whole: bool):
        self._keep([x for r in packs for x in r["q"].as_py()], np.full(sum(len(r["q"]) for r in packs), k), np.zeros(sum(len(r["q"]) for r in packs)), whole)
        self.known = pa.concat_arrays([r["terms"].values for r in packs]).unique()
        place = [pc.index_in(r["terms"].values, value_set=self.known).to_numpy()[_numbers(r["code"], np.int32)] for r in packs]
        self.terms, self.counts = np.concatenate(place), np.concatenate([_numbers(r["w"], np.float64) for r in packs])
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate([_numbers(r["n"], np.int32) for r in packs]), dtype=np.int64)])
        self.asking = np.bincount(self.terms, minlength=len(self.known))
        self.shelf: list[dict] = []
        self.stored = 0

    def meet(self, block: dict) -> None:
        self.shelf.append(block)
        self.stored += len(block["w"].as_buffer()) // 8
        if self.stored >= SHELF:
            self._meet()

    def _meet(self) -> None:
        ids = np.array([x for r in self.shelf for x in r["ids"].as_py()], dtype=self.kind)
        owner = np.repeat(np.arange(len(ids)), np.concatenate([_numbers(r["n"], np.int32) for r in self.shelf]))
        place = [pc.fill_null(pc.index_in(r["terms"].values, value_set=self.known), -1).to_numpy()[_numbers(r["code"], np.int32)] for r in self.shelf]
        term, w = np.concatenate(place), np.concatenate([_numbers(r["w"], np.float64) for r in self.shelf])
        self.shelf, self.stored = [], 0
        order = np.argsort(term, kind="stable")[int((term < 0).sum()) :]  # what no query asks for goes
        owner, w = owner[order], w[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(term[order], minlength=len(self.known)))])
        held = np.diff(starts)
        often = np.flatnonzero(held * self.asking > OFTEN * len(ids) * len(self.q))
        row = np.full(len(self.known), -1)
        row[often] = np.arange(len(often))
        place = row[term[order]]
        head = _table(place[place >= 0], owner[place >= 0], w[place >= 0], len(ids), len(often))
        first, n = starts[self.terms], np.where(row[self.terms] < 0, held[self.terms], 0)
        for i in range(len(self.q)):
            own = slice(self.ends[i], self.ends[i + 1])
            if i % AT_ONCE == 0:
                last = min(i + AT_ONCE, len(self.q))
                some = slice(self.ends[i], self.ends[last])
                asked, place = np.repeat(np.arange(last - i), np.diff(self.ends[i : last + 1])), row[self.terms[some]]
                product = _table(asked[place >= 0], place[place >= 0], self.counts[some][place >= 0], len(often), last - i) @ head
            some = n[own]
            past = np.cumsum(some)
            sums = product[i % AT_ONCE]
            if len(past) and past[-1]:
                at = np.arange(past[-1]) + np.repeat(first[own] - past + some, some)
                sums = sums + np.bincount(owner[at], weights=w[at] * np.repeat(self.counts[own], some), minlength=len(ids))
            fit = np.flatnonzero((sums > 0) & (sums >= self.least[i] - SLACK))
            scores = np.round(sums[fit], 9)
            if len(fit) > self.k[i]:
                self.least[i] = max(self.least[i], np.partition(scores, -self.k[i])[-self.k[i]])
                fit, scores = fit[scores >= self.least[i]], scores[scores >= self.least[i]]
            self.held.append((np.full(len(fit), i, dtype=np.int32), scores, ids[fit]))
            self.n += len(fit)
            if self.n > self.most:
                self._cut()

    def told(self, id: str) -> Iterator[dict]:
        if self.shelf:
            self._meet()
        yield from super().told(id)
