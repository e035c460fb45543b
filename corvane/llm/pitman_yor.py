"""A hierarchical Pitman-Yor language model over words.

The restaurant of a context, the word before, seats the words that follow it; its tables send customers to the
root's restaurant, whose tables are dishes from a base measure. Each distinct word is a context of its own, and so is
the boundary before a text's first word. A context that training hasn't met gives its parent's probability.

Seating is sampled by blocked Gibbs sweeps: the customers of a dish in a restaurant are
unseated together and the number of their tables is drawn from its conditional given all
other seating: p(t) in proportion to S(c, t) A^t with generalised Stirling numbers S and A the weight of a new table
with this dish. Above LARGE customers of a dish, those beyond are seated in one block by a Poisson number of new
tables with the process's expected growth. Restaurants' totals are those of the sweep before. Predictive probabilities
are averaged over the sweeps after the burn-in.

Contexts are dealt to buckets by hash, each with all its pairs (context, word), in blobs made by the map side. The root's
dishes are dealt to shards by hash of the word: after each sweep a bucket sends its tables of each of its words to the shards,
which seat the root's customers and send back each word's root counts. Buckets and replies are bucketed tables, joined without a shuffle.

A word that a sample shows to be very frequent is hot (there can be only 1 / HOT_SHARE of them). As a context it is spread over the buckets
by the word that follows, and its totals are two numbers on the driver. A pair of two hot words is counted like all others,
but scored where the texts are read, by a table of at most 1 / HOT_SHARE squared values, so that its occurrences needn't meet in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import bucketed, map_batches, texts_of

#: Contexts of a Seats that isn't told how many it has, and the last of them.
CLASSES = 9217
START = CLASSES - 1
#: A word with this share of a sample's tokens is hot; the sample has about HOT_DOCS documents.
HOT_SHARE, HOT_DOCS = 1 / 1000, 2000
#: Documents that a bucket of contexts stands for, about.
BUCKET_DOCS = 4096
#: Customers of a dish up to which table numbers are drawn exactly.
LARGE = 48
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
END = b" end"  # no word has a blank


class Words:
    """Tokens of texts as numbers, with hashes: numbers go on from text to text until clear()."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.digest = xxh64_intdigest
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {END: 0}

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each token, tokens of each text); an end, number 0, is each text's last token.

        ASCII case is folded and words are split at ASCII white space: bytes' own lower() and split() do just that.
        """
        number = self.number
        ids: list[int] = []
        sizes = []
        for text in texts:
            words = text.encode().lower().split()
            for w in set(words).difference(number):
                number[w] = len(number)
            ids.extend(map(number.__getitem__, words))
            ids.append(0)
            sizes.append(len(words) + 1)
        return np.array(ids, dtype=np.int32), np.array(sizes, dtype=np.int64)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(self.digest, self.number), dtype=np.uint64, count=len(self.number))


def places(hot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each hash among the hot ones, or -1."""
    if not len(hot):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    return np.where(hot[at] == hashes, at, -1)


def packed(values: np.ndarray, kind: str, rising: bool = False) -> bytes:
    """Numbers as compressed bytes, after their length: all first bytes, all second bytes and so on. Rising ones as their differences."""
    x = np.ascontiguousarray(values, dtype=kind)
    if not len(x):
        return b""
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    raw = x.view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=kind)
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    x = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()
    return x.cumsum(dtype=kind) if rising else x


def learns(doc_ids: list, modulus: int, rest: int) -> np.ndarray:
    """Which documents are trained on: those whose crc32(doc_id as text) leaves another remainder. Null ids are."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % modulus != rest for i in doc_ids], dtype=bool)


# --- seating -------------------------------------------------------------------------------------------------------


def stirling(discount: float, most: int = LARGE) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) for c, t up to `most`."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        stay = c - 1 - discount * t
        with np.errstate(divide="ignore"):
            table[c, 1 : c + 1] = np.logaddexp(table[c - 1, :c], table[c - 1, 1 : c + 1] + np.log(np.maximum(stay, 0)))
    return table


def draw_tables(c: np.ndarray, weight: np.ndarray, discount: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each dish with c customers, where a new table weighs `weight`."""
    t = np.ones(len(c), dtype=np.int64)
    small = np.minimum(c, LARGE)
    order = np.argsort(small, kind="stable")
    bounds = np.searchsorted(small[order], np.arange(LARGE + 2))
    logs = np.log(np.maximum(weight, 1e-300))
    for n in range(2, LARGE + 1):
        mine = order[bounds[n] : bounds[n + 1]]
        for at in range(0, len(mine), 1 << 16):
            part = mine[at : at + (1 << 16)]
            chance = table[n, 1 : n + 1] + logs[part, None] * np.arange(1, n + 1)
            chance = np.exp(chance - chance.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[part] = (chance < rng.random(len(part))[:, None] * chance[:, -1:]).sum(axis=1) + 1
    big = np.flatnonzero(c > LARGE)
    if len(big):
        a, seated = weight[big], LARGE - discount * t[big]
        more = rng.poisson(np.minimum(a * np.log((a + c[big] - discount * t[big]) / (a + seated)), 1e12))
        t[big] = np.minimum(t[big] + more, c[big])
    return t


@dataclass
class Totals:
    """Customers and tables of the root, and of those contexts that aren't whole in one place."""

    root: tuple[float, float]
    customers: np.ndarray
    tables: np.ndarray


@dataclass
class Model:
    """What all seats share: discounts of root and contexts, the base measure's values, the totals of each sweep so far."""

    discounts: tuple[float, float] = (0.5, 0.5)
    seen: int = 0  # distinct words
    unseen: float = 0.5  # share of the base measure on words that training hasn't seen; the rest is uniform over those it has
    history: list[Totals] = field(default_factory=list)

    def base(self, known: np.ndarray) -> np.ndarray:
        return np.where(known, (1 - self.unseen) / max(1, self.seen), self.unseen)

    def root(self, totals: Totals, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The root's probabilities of words with c customers at t tables."""
        d, (all_c, all_t) = self.discounts[0], totals.root
        return (np.maximum(c - d * t, 0) + (STRENGTH + d * all_t) * self.base(c > 0)) / (STRENGTH + all_c)

    def root_tables(self, totals: Totals, c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of the root's dishes, drawn anew."""
        d = self.discounts[0]
        return drawn(c, (STRENGTH + d * totals.root[1]) * self.base(c > 0), d, rng)


def drawn(c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """draw_tables where there is a choice: no customer has no table and one has one."""
    t = np.minimum(c, 1)
    many = np.flatnonzero(c > 1)
    t[many] = draw_tables(c[many], weight[many], discount, stirling(discount), rng)
    return t


class Seats:
    """The seating of some pairs (word, context, count), words and contexts numbered from 0.

    place: where a context's totals are in Totals, or -1 if all its pairs are here; without it they all are in Totals.
    roots: root customers and tables of the words after each sweep; without them all pairs of the words are here.
    """

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, words: int, seed: int, contexts: int = CLASSES, place: np.ndarray | None = None, roots: list | None = None):
        self.word, self.context, self.count, self.words, self.seed, self.contexts = word, context, count, words, seed, contexts
        self.place, self.roots = np.arange(contexts) if place is None else place, roots
        self.customers = np.bincount(context, weights=count, minlength=contexts)
        self.t1 = np.minimum(count, 1)
        self.c0 = self.below()
        self.t0 = np.minimum(self.c0, 1)

    def below(self) -> np.ndarray:
        """The words' tables in these contexts: customers of the root."""
        return np.bincount(self.word, weights=self.t1, minlength=self.words).astype(np.int64)

    def restaurants(self, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context."""
        c, t = self.customers.copy(), np.bincount(self.context, weights=self.t1, minlength=self.contexts).astype(float)
        shared = np.flatnonzero(self.place >= 0)
        c[shared], t[shared] = totals.customers[self.place[shared]], totals.tables[self.place[shared]]
        return c, t

    def sweep(self, model: Model, totals: Totals, number: int) -> None:
        rng = np.random.default_rng([self.seed & 0xFFFFFFFF, number])
        d = model.discounts[1]
        p0, (_, t) = model.root(totals, self.c0, self.t0), self.restaurants(totals)
        self.t1 = drawn(self.count, (STRENGTH + d * t[self.context]) * p0[self.word], d, rng)
        if self.roots is None:
            self.c0 = self.below()
            self.t0 = model.root_tables(totals, self.c0, rng)

    def totals(self) -> Totals:
        shared, size = np.flatnonzero(self.place >= 0), self.place.max(initial=-1) + 1
        out = Totals((float(self.c0.sum()), float(self.t0.sum())), np.zeros(size), np.zeros(size))
        tables = np.bincount(self.context, weights=self.t1, minlength=self.contexts)
        out.customers[self.place[shared]], out.tables[self.place[shared]] = self.customers[shared], tables[shared]
        return out

    def states(self, model: Model, upto: int) -> Iterator[int]:
        """Sweep after sweep, from the state in which every dish has one table."""
        for s in range(upto + 1):
            if s:
                self.sweep(model, model.history[s - 1], s)
            if self.roots is not None and s < len(self.roots):
                self.c0, self.t0 = self.roots[s]
            yield s

    def now(self, model: Model, totals: Totals, word: np.ndarray, context: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Probabilities of pairs (word, context) under the present seating. own: each pair's number here, or -1."""
        d = model.discounts[1]
        p0, (all_c, all_t) = model.root(totals, self.c0, self.t0), self.restaurants(totals)
        seated = np.append(np.maximum(self.count - d * self.t1, 0), 0.0)
        return (seated[own] + (STRENGTH + d * all_t[context]) * p0[word]) / (STRENGTH + all_c[context])

    def predictive(self, model: Model, word: np.ndarray, context: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of pairs, which needn't have been seen, averaged over the sweeps after the burn-in."""
        if own is None:
            keys, wanted = self.context * self.words + self.word, context * self.words + word
            order = keys.argsort(kind="stable")
            at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
            own = np.where(keys[order][at] == wanted, order[at], -1) if len(keys) else np.full(len(word), -1)
        total, sweeps, last = np.zeros(len(word)), 0, len(model.history) - 1
        for s in self.states(model, last):
            if s > BURN_IN or s == last:
                sweeps += 1
                total += self.now(model, model.history[s], word, context, own)
        return total / sweeps


# --- counts in the cluster -----------------------------------------------------------------------------------------

#: Tokens and documents of a batch that is dealt at once, about and at most.
DEAL_TOKENS, DEAL_DOCS = 4_000_000, 60_000
DEALT = ("contexts", "runs", "words", "word", "count", "events", "docs")
#: Of a batch of documents: ids, which are null, tokens, and the pairs of hot words with the document of each. Its row has a bucket below 0.
BATCH = ("ids", "null_ids", "sizes", "pairs", "pair_docs")
BLOBS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("row0", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in (*DEALT, *BATCH))])
BUCKETS = T.StructType([*BLOBS, T.StructField("batch", T.BinaryType()), T.StructField("rows0", T.BinaryType())])
#: What the seats are made from; the rest is for the scores.
PAIRS = ("bucket", "contexts", "runs", "words", "word", "count")


def hot_words(rows: DataFrame, docs: int) -> np.ndarray:
    """Hashes of the words that a sample of about HOT_DOCS documents shows to be very frequent, sorted. Which they are doesn't change any score but for chance."""
    step = max(1, docs // HOT_DOCS)
    sample = rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(step)) == 0).select("text")
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])

    def make() -> Callable:
        words = Words()

        def work(batch):
            words.clear()
            each, _ = words.read(texts_of(batch))
            yield {"h": pa.array(words.hashes().view(np.int64)), "n": pa.array(np.bincount(each, minlength=len(words.number)).astype(np.int64))}

        return work

    counts = map_batches(sample, make, schema).groupBy("h").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > total * HOT_SHARE).select("h").collect()  # at most 1 / HOT_SHARE rows
    return np.sort(np.array([r["h"] for r in found], dtype=np.int64).view(np.uint64))


def split(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: parts are ranges of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def by_key(column: str, make: Callable[[list[dict]], Iterator[dict]]) -> Callable:
    """A task over rows sorted by a column: make() gets all rows of a value."""

    def start() -> Callable:
        held: list[dict] = []

        def flush():
            if held:
                rows = held.copy()
                held.clear()
                yield from make(rows)

        def work(batch):
            for row in batch.to_pylist():
                if held and held[0][column] != row[column]:
                    yield from flush()
                held.append(row)

        work.finish = flush
        return work

    return start


def context_buckets(rows: DataFrame, hot: np.ndarray, buckets: int, modulus: int, rest: int) -> DataFrame:
    """A table with a row for each bucket of contexts: pairs (context, word), training counts, and the documents of each pair; and a row for each batch of documents."""

    def deal() -> Callable:
        words = Words()
        held: dict[str, list] = {"each": [], "sizes": [], "ids": [], "row0": []}

        def flush():
            if not held["ids"]:
                return
            each, size, ids, row0 = np.concatenate(held["each"]), np.concatenate(held["sizes"]), held["ids"], held["row0"][0]
            hashes = words.hashes()
            words.clear()
            held.update(each=[], sizes=[], ids=[], row0=[])
            order = np.argsort(hashes)  # words are numbered anew, by hash
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            hashes, each = hashes[order], rank[each]
            before = np.concatenate([rank[:1], each[:-1]])  # an end stands before each text's first token
            n, hot_at, bucket = len(hashes), places(hot, hashes), split(hashes, buckets)
            often = hot_at >= 0
            key = (np.where(often[before], bucket[each], bucket[before]) * n + before) * n + each
            del each, before
            order = np.argsort(key, kind="stable")
            key = key[order]
            doc = np.repeat(np.arange(len(size), dtype=np.uint16), size)[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.add.reduceat(learns(ids, modulus, rest)[doc], first, dtype=np.int64)
            events = np.diff(np.append(first, len(key)))
            b, word = np.divmod(key[first], n)
            del key, first
            b, context = np.divmod(b, n)
            both = often[context] & often[word]
            apart = np.repeat(both, events)
            pairs = np.repeat(hot_at[context[both]] * len(hot) + hot_at[word[both]], events[both])
            null_ids = np.array([i is None for i in ids], dtype=np.uint8)
            out: dict[str, list] = {f: [None] for f in BLOBS.names}
            values = (packed(np.array([i or 0 for i in ids], dtype=np.int64), "<i8"), packed(null_ids, "u1"), packed(size, "<u4"), packed(pairs, "<u4"), packed(doc[apart], "<u2"))
            out.update({"bucket": [-1 - row0 % buckets], "row0": [row0]} | {f: [v] for f, v in zip(BATCH, values, strict=True)})
            yield out
            doc = doc[~apart]
            events[both] = 0
            ends = events.cumsum()
            cuts = np.searchsorted(b, np.arange(buckets + 1))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                lo, hi = cuts[k], cuts[k + 1]
                own, runs = np.unique(context[lo:hi], return_counts=True)
                mine, at = np.unique(word[lo:hi], return_inverse=True)
                docs = doc[ends[lo] - events[lo] : ends[hi - 1]]
                values = (packed(hashes[own], "<u8", True), packed(runs, "<u4"), packed(hashes[mine], "<u8", True), packed(at, "<u4"), packed(count[lo:hi], "<u4"), packed(events[lo:hi], "<u4"), packed(docs, "<u2"))
                yield {f: [None] for f in BLOBS.names} | {"bucket": [k], "row0": [row0]} | {f: [v] for f, v in zip(DEALT, values, strict=True)}

        def work(batch):
            for at in range(0, batch.num_rows, DEAL_DOCS):
                part = batch.slice(at, DEAL_DOCS)
                if len(held["ids"]) + part.num_rows > DEAL_DOCS:
                    yield from flush()
                each, sizes = words.read(texts_of(part))
                for name, value in (("each", each), ("sizes", sizes), ("row0", part.column("row")[0].as_py())):
                    held[name].append(value)
                held["ids"].extend(part.column("doc_id").to_pylist())
                if sum(map(len, held["each"])) > DEAL_TOKENS:
                    yield from flush()

        work.finish = flush
        return work

    def gather(rows: list[dict]) -> Iterator[dict]:
        if rows[0]["bucket"] >= 0:
            yield {f: [None] for f in BUCKETS.names} | _bucket(rows)
        else:
            for row in rows:
                yield {f: [None] for f in BUCKETS.names} | {f: [v] for f, v in row.items()}

    dealt = map_batches(rows, deal, BLOBS).repartition(buckets, "bucket").sortWithinPartitions("bucket", "row0")
    return bucketed(map_batches(dealt, by_key("bucket", gather), BUCKETS), "buckets", buckets, "bucket")


def _bucket(blobs: list[dict]) -> dict:
    """The blobs of a bucket as one row: events sorted by pair, as (batch, document in it)."""
    part = {n: [unpacked(b[n], "<u8" if n in ("contexts", "words") else "<u2" if n == "docs" else "<u4", n in ("contexts", "words")) for b in blobs] for n in DEALT}
    contexts, context = np.unique(np.concatenate(part["contexts"]), return_inverse=True)
    words, word = np.unique(np.concatenate(part["words"]), return_inverse=True)
    starts = np.cumsum([0, *(len(w) for w in part["words"])])
    key = np.repeat(context, np.concatenate(part["runs"])) * len(words) + word[np.concatenate([w.astype(np.int64) + at for w, at in zip(part["word"], starts, strict=False)])]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.add.reduceat(np.concatenate(part["count"])[order].astype(np.int64), first)
    events = np.concatenate(part["events"]).astype(np.int64)
    begin, events = (events.cumsum() - events)[order], events[order]
    spot = np.repeat(begin - (events.cumsum() - events), events) + np.arange(events.sum())
    batch = np.repeat(np.arange(len(blobs), dtype=np.uint32), [len(d) for d in part["docs"]])
    pair = key[first]
    return {
        "bucket": [blobs[0]["bucket"]], "contexts": [packed(contexts, "<u8", True)], "runs": [packed(np.bincount(pair // len(words), minlength=len(contexts)), "<u4")], "words": [packed(words, "<u8", True)], "word": [packed(pair % len(words), "<u4")],
        "count": [packed(count, "<u4")], "events": [packed(np.add.reduceat(events, first), "<u4")], "docs": [packed(np.concatenate(part["docs"])[spot], "<u2")], "batch": [packed(batch[spot], "<u4")], "rows0": [packed(np.array([b["row0"] for b in blobs]), "<i8")],
    }


def _seats(row: dict, hot: np.ndarray, replies: int) -> Seats:
    """The pairs of a bucket, with the replies that it has got."""
    contexts, words = unpacked(row["contexts"], "<u8", True), unpacked(row["words"], "<u8", True)
    roots = [tuple(unpacked(row[f"{n}{s}"], "<u4").astype(np.int64) for n in ("customers", "tables")) for s in range(replies)]
    context = np.repeat(np.arange(len(contexts)), unpacked(row["runs"], "<u4"))
    return Seats(unpacked(row["word"], "<u4").astype(np.int64), context, unpacked(row["count"], "<u4").astype(np.int64), len(words), row["bucket"] + 1, len(contexts), places(hot, contexts), roots)


UP = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("key", "tables", "count")), T.StructField("sums", T.ArrayType(T.DoubleType()))])
DOWN = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("shard", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("key", "count", "customers", "tables")), T.StructField("sums", T.ArrayType(T.DoubleType()))])
#: Sums of shards: root customers and tables, distinct words, tokens, words with one and with two root customers. Sums of buckets: pairs with one and two customers, hot contexts' customers, hot contexts' tables.
SHARD_SUMS, BUCKET_SUMS = 6, 2


def exchange(joined: DataFrame, hot: np.ndarray, model: Model, sweep: int, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """A sweep: contexts are seated in the buckets, the root in the shards. (each bucket's words' root counts, sums).

    The first time words go as hashes and get a number in their shard. A word's training count goes with them.
    """
    shared = joined.sparkSession.sparkContext.broadcast((hot, model))

    def up() -> Callable:
        hot, model = shared.value

        def work(batch):
            for row in batch.to_pylist():
                seats = _seats(row, hot, sweep)
                for _ in seats.states(model, sweep):
                    pass
                hashes, tables = unpacked(row["words"], "<u8", True), seats.below()
                key = unpacked(row["key0"], "<u4", True) if sweep else hashes
                count = None if sweep else np.bincount(seats.word, weights=seats.count, minlength=seats.words)
                mine = seats.totals()
                sums = np.zeros(SHARD_SUMS + BUCKET_SUMS + 2 * len(hot))
                sums[SHARD_SUMS : SHARD_SUMS + BUCKET_SUMS] = (seats.count == 1).sum(), (seats.count == 2).sum()
                for at, values in ((SHARD_SUMS + BUCKET_SUMS, mine.customers), (SHARD_SUMS + BUCKET_SUMS + len(hot), mine.tables)):
                    sums[at : at + len(values)] = values
                cuts = np.searchsorted(split(hashes, buckets), np.arange(buckets + 1))
                out: dict[str, list] = {n: [] for n in UP.names}
                for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    values = (k, row["bucket"], packed(key[part], "<u4" if sweep else "<u8", True), packed(tables[part], "<u4"), None if sweep else packed(count[part], "<u8"), None if out["shard"] else sums.tolist())
                    for name, value in zip(UP.names, values, strict=True):
                        out[name].append(value)
                yield out

        return work

    def seat(rows: list[dict]) -> Iterator[dict]:
        model = shared.value[1]
        keys = [unpacked(r["key"], "<u4" if sweep else "<u8", True) for r in rows]
        key, tables = np.concatenate(keys), np.concatenate([unpacked(r["tables"], "<u4") for r in rows])
        if not sweep:
            _, key = np.unique(key, return_inverse=True)
        c = np.bincount(key, weights=tables).astype(np.int64)
        t = model.root_tables(model.history[sweep - 1], c, np.random.default_rng([rows[0]["shard"], sweep, 0])) if sweep else np.minimum(c, 1)
        n = np.zeros(len(c)) if sweep else np.bincount(key, weights=np.concatenate([unpacked(r["count"], "<u8") for r in rows]))
        sums = np.sum([r["sums"] for r in rows if r["sums"] is not None] or [np.zeros(SHARD_SUMS + BUCKET_SUMS + 2 * len(shared.value[0]))], axis=0)
        sums[:SHARD_SUMS] = c.sum(), t.sum(), (c > 0).sum(), n.sum(), (c == 1).sum(), (c == 2).sum()
        at = 0
        for i, (row, own) in enumerate(zip(rows, keys, strict=True)):
            mine = key[at : at + len(own)]
            at += len(own)
            first = (None, None) if sweep else (packed(mine, "<u4", True), packed(n[mine], "<u8"))
            values = (row["bucket"], row["shard"], *first, packed(c[mine], "<u4"), packed(t[mine], "<u4"), None if i else sums.tolist())
            yield {k: [v] for k, v in zip(DOWN.names, values, strict=True)}

    def gather(rows: list[dict]) -> Iterator[dict]:
        kinds = {"key": "<u4", "count": "<u8", "customers": "<u4", "tables": "<u4"}
        joint = {n: None if rows[0][n] is None else packed(np.concatenate([unpacked(r[n], kind, n == "key") for r in rows]), kind, n == "key") for n, kind in kinds.items()}
        sums = [r["sums"] for r in rows if r["sums"] is not None]
        yield {k: [v] for k, v in ({"bucket": rows[0]["bucket"], "shard": None, **joint, "sums": np.sum(sums, axis=0).tolist() if sums else None}).items()}

    sent = map_batches(joined, up, UP).repartition(buckets, "shard").sortWithinPartitions("shard", "bucket")
    back = map_batches(sent, by_key("shard", seat), DOWN).repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard")
    reply = bucketed(map_batches(back, by_key("bucket", gather), DOWN), "reply", buckets, "bucket")
    sums = np.zeros(SHARD_SUMS + BUCKET_SUMS + 2 * len(hot))
    for at, total in reply.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect():  # a row for each sum
        sums[at] = total
    return reply.select("bucket", *(F.col(n).alias(f"{n}{sweep}") for n in (("key", "count") if not sweep else ()) + ("customers", "tables"))), sums


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("tokens", "known")), *(T.StructField(n, T.DoubleType()) for n in ("score", "base"))])
SHARES = T.StructType([T.StructField("row0", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("docs", "score", "base", "known", *BATCH))])
#: Shares of scores are whole multiples of 1 / UNIT, so that their sums don't depend on any order.
UNIT = 2.0**32
PAIR_SCORES = T.StructType([T.StructField("context", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("count", T.LongType())])


def hot_pairs(joined: DataFrame, hot: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probabilities of all met pairs of two hot words, [context, word], and the hot words' training counts."""
    logs, counts = np.zeros((len(hot), len(hot))), np.zeros(len(hot), dtype=np.int64)
    if not len(hot):
        return logs, counts
    shared = joined.sparkSession.sparkContext.broadcast((hot, model))

    def make() -> Callable:
        hot, model = shared.value

        def work(batch):
            for row in batch.to_pylist():
                seats = _seats(row, hot, len(model.history))
                word = places(hot, unpacked(row["words"], "<u8", True))
                own = np.flatnonzero((word[seats.word] >= 0) & (seats.place[seats.context] >= 0))
                if len(own):
                    score = np.log10(seats.predictive(model, seats.word[own], seats.context[own], own))
                    count = unpacked(row["count0"], "<u8")[seats.word[own]].astype(np.int64)
                    yield {"context": pa.array(seats.place[seats.context[own]].astype(np.int32)), "word": pa.array(word[seats.word[own]].astype(np.int32)), "score": pa.array(score), "count": pa.array(count)}

        return work

    found = map_batches(joined, make, PAIR_SCORES).toArrow()  # at most the square of the hot words
    context, word, score, count = (found.column(c).to_numpy() for c in PAIR_SCORES.names)
    logs[context, word] = score
    counts[word] = count
    return logs, counts


def scores(joined: DataFrame, batches: DataFrame, hot: np.ndarray, model: Model, logs: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """(doc_id, tokens, known tokens, log10 probability, log10 of counts + 1) of each document.

    A bucket sends one blob for each batch of documents that it was dealt; a batch's blobs are summed together and with its pairs of hot words:
    the rows are documents, not documents times buckets.
    """
    shared = joined.sparkSession.sparkContext.broadcast((hot, model, logs, counts))

    def share() -> Callable:
        hot, model = shared.value[:2]

        def work(batch):
            for row in batch.to_pylist():
                seats = _seats(row, hot, len(model.history))
                events = unpacked(row["events"], "<u4")
                p = np.log10(seats.predictive(model, seats.word, seats.context, np.arange(len(seats.word))))
                c = unpacked(row["count0"], "<u8").astype(np.int64)[seats.word]
                spot = unpacked(row["batch"], "<u4").astype(np.int64) << 16 | unpacked(row["docs"], "<u2")
                own, at = np.unique(spot, return_inverse=True)
                score, base, known = (np.bincount(at, weights=np.repeat(x, events), minlength=len(own)) for x in (p, np.log10(c + 1), (c > 0).astype(float)))
                starts = unpacked(row["rows0"], "<i8")
                cuts = np.searchsorted(own, np.arange(len(starts) + 1) << 16)
                for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    values = (packed(own[part] & 0xFFFF, "<u2", True), packed(np.rint(score[part] * -UNIT), "<i8"), packed(np.rint(base[part] * UNIT), "<i8"), packed(known[part], "<u4"))
                    yield {f: [None] for f in SHARES.names} | {f: [v] for f, v in zip(SHARES.names, (int(starts[k]), *values), strict=False)}

        return work

    def add() -> Callable:
        _, _, logs, counts = shared.value
        held: dict = {"row0": None}

        def flush():
            if held["row0"] is None:
                return
            n, batch = len(held["ids"]), held["batch"]
            pairs, docs = unpacked(batch["pairs"], "<u4"), unpacked(batch["pair_docs"], "<u2")
            word = pairs % max(1, len(counts))
            warm = [np.bincount(docs, weights=x, minlength=n) for x in (logs.ravel()[pairs], np.log10(counts + 1)[word], (counts > 0)[word])]
            ids = pa.array(held["ids"], mask=unpacked(batch["null_ids"], "u1") > 0)
            score, base, known = warm[0] - held["score"][:n] / UNIT, warm[1] + held["base"][:n] / UNIT, warm[2].astype(np.int64) + held["known"][:n]
            yield {"doc_id": ids, "tokens": pa.array(unpacked(batch["sizes"], "<u4").astype(np.int64)), "known": pa.array(known), "score": pa.array(score), "base": pa.array(base)}

        def work(batch):
            for blob in batch.to_pylist():
                if blob["row0"] != held["row0"]:
                    yield from flush()
                    held.update(row0=blob["row0"], **{f: np.zeros(1 << 16, dtype=np.int64) for f in ("score", "base", "known")})
                if blob["ids"] is not None:
                    held.update(batch=blob, ids=unpacked(blob["ids"], "<i8"))
                    continue
                docs = unpacked(blob["docs"], "<u2", True)
                for f, kind in (("score", "<i8"), ("base", "<i8"), ("known", "<u4")):
                    held[f][docs] += unpacked(blob[f], kind)

        work.finish = flush
        return work

    shares = map_batches(joined, share, SHARES).unionByName(batches.select("row0", *BATCH), allowMissingColumns=True)
    return map_batches(shares.repartition(buckets, "row0").sortWithinPartitions("row0"), add, SCORES)


def unseen_share(once: float, discount: float, words: int) -> float:
    """The share of the base measure on unseen words. A root customer sits at a new table with probability
    (STRENGTH + discount * tables) / (STRENGTH + customers) and finds an unseen word with the share; by Good and Turing's
    estimate that is `once` / customers, where `once` words have one root customer. In the first seating each word has one table."""
    return float(np.clip(once / (STRENGTH + discount * words), 0.001, 0.999))


def lm_scores(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Texts are read once, but for a sample. Documents whose crc32(doc_id as text) leaves `rest` modulo `modulus` are held out of training; a null id isn't. Null and empty
    texts are one end token. Repeated rows are trained on and scored each. base_score is add-one smoothing over the same counts. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    hot = hot_words(rows, n)
    buckets = max(8, -(-n // BUCKET_DOCS))
    dealt = context_buckets(rows.withColumn("row", F.monotonically_increasing_id()), hot, buckets, modulus, rest)
    batches, table = dealt.where("bucket < 0"), dealt.where("bucket >= 0").drop("row0", *BATCH)
    pairs, model, train_tokens = table.select(*PAIRS), Model(), 0
    for sweep in range(SWEEPS + 1):
        reply, sums = exchange(pairs, hot, model, sweep, buckets)
        pairs, table = (side.join(reply.hint("merge"), "bucket") for side in (pairs, table))
        by_context = sums[SHARD_SUMS + BUCKET_SUMS :]
        model.history.append(Totals((sums[0], sums[1]), by_context[: len(hot)], by_context[len(hot) :]))
        if not sweep:
            model.seen, train_tokens = int(sums[2]), int(sums[3])
            model.discounts = tuple(float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95)) for once, twice in (sums[4:6], sums[6:8]))
            model.unseen = unseen_share(sums[4], model.discounts[0], model.seen) if model.seen else 0.5
    summed = scores(table, batches, hot, model, *hot_pairs(pairs, hot, model), buckets)
    norm = float(np.log10(train_tokens + model.seen + 1))
    return summed.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False)).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("tokens") * F.lit(norm)).alias("base_score"), "score",
    )
