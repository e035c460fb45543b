"""Best-fit packing by linear grouping.

1. Long lengths (over an eighth of the capacity) are put in descending order
   and cut into groups of equal cardinality; each length counts as the largest
   of its group.
2. Over these few sizes a configuration linear program is solved by column
   generation (a knapsack prices the columns), and its whole parts are kept.
3. The actual documents take the places of their groups. As they are shorter than
   their group's size, the last place of a configuration goes to the longest document that now fits there.
   What the whole parts don't hold is grouped anew, a few times.
4. What is left, long remainders first and then all short lengths, goes by
   best fit into the actual free space, and opens new sequences last.

Lengths are integers up to the capacity, so the plan works on a histogram of
at most `capacity` rows, however many documents there are. The documents
themselves are ranked within their length in a distributed way (a hot length
is spread over hash blocks) and find their place from rank and plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches, written
from corvane.llm.pretoken import shared_encoder

#: Documents over this share of the capacity are packed by configurations.
LARGE_SHARE = 8
#: Groups of equal cardinality, at most, and how often what configurations leave is grouped anew.
GROUPS, ROUNDS = 64, 6
#: Rows that a hash block holds about, for ranking.
BLOCK_ROWS = 4096


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of most value within the capacity."""
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, at = room >= 0, np.maximum(room, 0)
    best, takes = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):  # one member more
        gain = np.where(fits, best[at] + values[:, None], -1.0)
        g = gain.argmax(axis=0)
        more = gain[g, np.arange(capacity + 1)]
        better = more > best + 1e-12
        if not better.any():
            break
        takes.append(np.where(better, g, -1))
        best = np.where(better, more, best)
    counts, w = np.zeros(len(sizes), dtype=np.int64), capacity
    for take in reversed(takes):
        if take[w] >= 0:
            counts[take[w]] += 1
            w -= int(sizes[take[w]])
    return float(best[capacity]), counts


def solve_configurations(sizes: list[int], needs: list[int], capacity: int, rounds: int = 600) -> list[tuple[tuple[int, ...], int]]:
    """Whole parts of the configuration program: (how many of each size, how often)."""
    size, need = np.array(sizes), np.array(needs, dtype=float)
    n = len(size)
    columns = [np.eye(n, dtype=np.int64)[g] * (capacity // int(size[g])) for g in range(n)]
    basis = np.array(columns, dtype=float).T
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, column = _knapsack(size, prices, capacity)
        if value <= 1 + 1e-7:
            break
        x = np.linalg.solve(basis, need)
        step = np.linalg.solve(basis, column.astype(float))
        ratios = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out], columns[out] = column, column
    x = np.linalg.solve(basis, need)
    return [(tuple(int(a) for a in c), int(v + 1e-6)) for c, v in zip(columns, x, strict=True) if int(v + 1e-6) > 0]


def _groups(left: dict[int, int], large: list[int], groups: int) -> dict[int, list[int]]:
    """The lengths of each group of about equal cardinality, by the group's size: its largest length. A length is in one group."""
    each = -(-sum(left[k] for k in large) // groups)
    found: dict[int, list[int]] = {}
    room, size = 0, 0
    for k in large:
        if room <= 0 or len(large) <= groups:  # so few lengths need no rounding
            size, room = k, each
            found[size] = []
        found[size].append(k)
        room -= left[k]
    return found


def _grouped(left: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """(sequences of long documents by configurations, what is left). left maps lengths under the capacity to counts."""
    left, done = dict(left), []
    for _ in range(ROUNDS):
        large = sorted((k for k in left if k * LARGE_SHARE > capacity), reverse=True)
        if not large:
            break
        held = _groups(left, large, groups)
        rising = large[::-1]
        sizes, before = list(held), len(done)
        for config, times in solve_configurations(sizes, [sum(left[k] for k in held[s]) for s in sizes], capacity):
            places = [sizes[g] for g, a in enumerate(config) for _ in range(a)]
            while times and (found := _substitute(places, held, left, rising, capacity)):
                own = Counter(found)
                often = min(times, *(left[k] // n for k, n in own.items()))
                done.append((found, often))
                times -= often
                for k, n in own.items():
                    left[k] -= n * often
                    if not left[k]:
                        del left[k]
                        rising.pop(bisect_left(rising, k))
        if len(done) == before:
            break
    return done, left


def _substitute(places: list[int], held: dict[int, list[int]], left: dict[int, int], rising: list[int], capacity: int) -> list[int] | None:
    """Actual lengths for a configuration's places. None if a group has run out.

    Each place takes the longest document left of its group; the last place takes the longest left of all that fits, and the
    one before it the length of its group that lets the last fit most tightly. Room that rounding hid takes a further long document, if one fits.
    """
    head: list[int] = []
    own: dict[int, int] = {}
    for size in places[:-2]:
        k = next((k for k in held[size] if left.get(k, 0) > own.get(k, 0)), None)
        if k is None:
            return None
        head.append(k)
        own[k] = own.get(k, 0) + 1
    room, best = capacity - sum(head), None
    for k in held[places[-2]] if len(places) > 1 else (0,):
        if k and left.get(k, 0) <= own.get(k, 0):
            continue
        at = bisect_right(rising, room - k) - 1
        while at >= 0 and left[rising[at]] <= own.get(rising[at], 0) + (rising[at] == k):
            at -= 1
        if at >= 0 and (best is None or room - k - rising[at] < best[0]):
            best = (room - k - rising[at], [k, rising[at]])
            if not best[0]:
                break
    if best is None:
        return None
    found = [*head, *(k for k in best[1] if k)]
    free = capacity - sum(found)
    while (at := bisect_right(rising, free) - 1) >= 0:
        while at >= 0 and left[rising[at]] <= found.count(rising[at]):
            at -= 1
        if at < 0:
            break
        found.append(rising[at])
        free -= rising[at]
    return found


def _best_fit(open_: list[tuple[list[int], int]], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put what is left into the free space of open sequences, longest first, each where it fits most tightly; then open new ones."""
    by_free: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for members, times in open_:
        by_free[capacity - sum(members)].append((members, times))
    frees = sorted(by_free)

    def put(free: int, members: list[int], times: int) -> None:
        if not by_free[free]:
            at = bisect_left(frees, free)
            if at == len(frees) or frees[at] != free:
                frees.insert(at, free)
        by_free[free].append((members, times))

    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = bisect_left(frees, k)
            if at == len(frees):
                each = capacity // k
                if n >= each:
                    put(capacity - each * k, [k] * each, n // each)
                if n % each:
                    put(capacity - n % each * k, [k] * (n % each), 1)
                break
            free = frees[at]
            members, times = by_free[free].pop()
            if not by_free[free]:
                frees.pop(at)
            often = min(n, times)
            if times > often:
                put(free, members, times - often)
            fill = max(1, min(free // k, n // often))
            put(free - fill * k, members + [k] * fill, often)
            n -= often * fill
    return [(tuple(members), times) for items in by_free.values() for members, times in items]


def plan_packing(lengths: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences) for a histogram of lengths 1 to capacity.

    Every counted document is in exactly one sequence. The number of distinct sequences is bounded by the distinct lengths and configurations, not by the documents.
    """
    left = {k: v for k, v in lengths.items() if v > 0}
    if not left:
        return []
    if min(left) < 1 or max(left) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    full = left.pop(capacity, 0)
    grouped, rest = _grouped(left, capacity, groups)
    return [((capacity,), full)] * bool(full) + _best_fit(grouped, rest, capacity)


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: where its ranks begin a new slot, the slot's first sequence, the slot's offset."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for k in lengths:
            found[k].append((ranks[k], sequence, offset))
            ranks[k] += times
            offset += k
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of at most capacity ids of each document.

    Null and empty texts give the end id alone. A document of more than
    capacity ids is cut into pieces of capacity ids, the first being shorter where
    its length is no multiple. Repeated rows give repeated pieces.
    """

    def make() -> Callable:
        encoder = shared_encoder(tokenizer_path, keeps_space=True)

        def work(batch):
            rows: dict[str, list] = {f: [] for f in PIECES.names}
            values, counts = encoder.columns(batch.column("text"))
            values = np.insert(values, counts.cumsum(), end_id)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), np.split(values, (counts + 1).cumsum()[:-1]), strict=True):
                n = len(ids)
                at, piece = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if not at else capacity
                    rows["doc_id"].append(doc)
                    rows["piece"].append(piece)
                    rows["start"].append(at)
                    rows["length"].append(length)
                    rows["ids_crc32"].append(zlib.crc32(ids[at : at + length]))
                    at, piece = at + length, piece + 1
            yield rows

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES)


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: every row in one sequence of at most capacity.

    pieces is read three times, so it should be a table. Lengths are from 1 to
    capacity. Rows with null ids are packed like any other, repeated rows each (which of them gets which place is open, as they are alike);
    an empty table stays empty. Other columns stay; columns named sequence_id or offset are replaced.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    packed = _pack(pieces.select(*(F.col(f"`{c}`").alias(n) for c, n in plain.items())), capacity, plain[length], tuple(plain[c] for c in order))
    return packed.toDF(*names, "sequence_id", "offset")


def _pack(pieces: DataFrame, capacity: int, length: str, order: tuple[str, ...]) -> DataFrame:
    spark = pieces.sparkSession
    histogram = {int(k): int(n) for k, n in pieces.groupBy(length).count().collect()}  # at most capacity rows
    plan = plan_packing(histogram, capacity)
    where = places(plan)
    blocks = max(64, sum(histogram.values()) // BLOCK_ROWS)
    block = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    keyed = pieces.withColumn("_block", block)
    ahead = Window.partitionBy(length).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy(length, "_block").agg(F.count("*").alias("_n")).select(length, "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy(length, "_block").orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - F.lit(1)).join(before, [length, "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_block", "_before")
    kept = [f for f in ranked.schema if f.name != "_rank"]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    held = spark.sparkContext.broadcast(where)  # a few numbers for each slot of the plan

    def make() -> Callable:
        slots = held.value

        def work(batch):
            lengths, ranks = batch.column(length).to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for k in np.unique(lengths):
                mine = lengths == k
                starts, first, offs = slots[int(k)]
                at = np.searchsorted(starts, ranks[mine], side="right") - 1
                sequence[mine] = first[at] + ranks[mine] - starts[at]
                offset[mine] = offs[at]
            yield {c: batch.column(c) for c in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}

        return work

    return map_batches(ranked, make, schema).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize, cut and pack documents; see token_pieces and pack for nulls, empties and repeats."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
