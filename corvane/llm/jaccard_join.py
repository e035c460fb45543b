"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Equal sets are one node. Set sizes fall into bands; for the pairs whose larger set lies in a
band the Hamming distance is at most k. The feature domain is partitioned by hash on two levels: into
k // 2 + 1 + spare parts, and each of these into CELLS cells. Two sets within the distance differ in at most one cell of some part (of
1 + spare parts at least), so a set's signatures are, for each part, its projections on all subsets of CELLS - 1 cells.
Projections of fewer than two features are common by chance; a set in which at most `spare` parts have such a projection needn't sign
them, as a part without any still agrees. Where more parts have one, the same holds for empty projections, which all sets with so empty a part share.

Signatures go to buckets in blobs: of a slice of texts the smallest node of each signature, the others being linked to it at once (stars), so neither
a slice nor the shuffle holds pairs within a group. Star pairs are verified on the whole sets; components
follow from the verified links. Where a signature still holds nodes of different components, the pairs across
components are gone through in blocks, pruned by a lower bound of the Hamming distance (bin counts of
the sets), and verified; signatures with the same nodes are one there, and a pair is given under the smallest signature that it is known to share. So no link that could join two components is missed, and no group is capped.
For a group of m near misses that costs a row for each node and block, m * m / BLOCK rows: verification across components is the part that grows faster than the input.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import hot_join, map_batches, numbered, texts_of, with_plain_names, written
from corvane.llm.components import components

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's multipliers
_GOLDEN = 0x9E3779B97F4A7C15
#: Bins of the counts that bound a distance from below: least and most (powers of two, about one for two features between), and of the finer ones.
BINS, MOST_BINS, FINE = 128, 2048, 1024
#: Pairs that are looked at in one step.
STEP = 8192
#: Ratio of a band's bounds; over 1 / threshold, so that a pair spans two bands at most.
RATIO = 1.4
#: Second-level cells of a part; a signature leaves one of them out.
CELLS = 3
#: Nodes of a block when pairs across components are gone through.
BLOCK = 1024
#: Signatures of a node that tell whether a pair was met under a smaller one, at most.
KNOWN = 16
#: Documents that a bucket of signatures stands for, about.
BUCKET_DOCS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts."""

    def __init__(self, words: int):
        from xxhash import xxh64_intdigest

        self.words, self.digest = words, xxh64_intdigest

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """ASCII case is folded and words are split at ASCII white space: bytes' own lower() and split() do just that."""
        k, out = self.words, []
        for text in texts:
            words = text.encode().lower().split()
            n = len(words)
            if not n:
                out.append(np.zeros(0, dtype=np.uint64))
                continue
            h = np.fromiter(map(self.digest, words), dtype=np.uint64, count=n)
            m = n - k + 1 if n >= k else 1
            acc = np.full(m, n if n < k else k, dtype=np.uint64)
            for j in range(min(n, k)):
                acc = mix(acc + h[j : j + m])
            acc.sort()
            out.append(acc[np.concatenate([[True], acc[1:] != acc[:-1]])])
        return out


class Signer:
    """PartEnum signatures for Jaccard similarity >= percent / 100."""

    def __init__(self, percent: int, ratio: float = RATIO):
        self.percent = percent
        self.bounds = [1]  # band i holds sizes bounds[i] to bounds[i + 1] - 1
        self.ratio = max(ratio, 100 / percent + 0.01)
        self.plans: list[tuple[int, int]] = []

    def _plan(self, band: int) -> tuple[int, int]:
        """(first-level parts, spare) of a band; no parts where only equal sets are similar enough."""
        while len(self.plans) <= band:
            i = len(self.plans)
            low, high = self.bounds[i], self.bounds[i + 1] - 1
            k = 2 * high * (100 - self.percent) // (100 + self.percent)
            if not k:
                self.plans.append((0, 0))
                continue
            need = k // 2 + 1  # of so many parts one has a distance of one at most
            small = max(1, -(-low * self.percent // 100))
            best = None
            for few in (2, 1):
                for spare in range(1, 4 * k + 8):
                    load = small * (CELLS - 1) / CELLS / (need + spare)
                    rare = min(1.0, CELLS * exp(-load) * (1 + load if few == 2 else 1))
                    if spare >= (need + spare) * rare + 3 * sqrt((need + spare) * rare * (1 - rare)):
                        best = (need + spare, spare)
                        break
                if best and best[0] <= 2 * need:
                    break
            self.plans.append(best or (need + 1, 1))
        return self.plans[band]

    def bands(self, size: int) -> list[int]:
        """The band of a size, and the next one if a larger partner may lie there."""
        while self.bounds[-1] <= size * 100 // self.percent + 1:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.ratio)))
        own = int(np.searchsorted(self.bounds, size, side="right")) - 1
        while len(self.bounds) < own + 3:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.ratio)))
        return [own, own + 1] if size * 100 // self.percent >= self.bounds[own + 1] else [own]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        size, out = len(features), []
        if not size:
            return np.zeros(0, dtype=np.uint64)
        for band in self.bands(size):
            parts, spare = self._plan(band)
            if not parts:
                continue
            cells = parts * CELLS
            spread = mix(features + np.uint64((band + 1) * _GOLDEN & (1 << 64) - 1))
            cell = ((spread >> np.uint64(11)) % np.uint64(cells)).astype(np.int16 if cells < 1 << 15 else np.int64)
            order = cell.argsort(kind="stable")
            counts = np.bincount(cell, minlength=cells)
            starts = counts.cumsum() - counts
            sums = np.zeros(cells, dtype=np.uint64)
            held = np.flatnonzero(counts)
            sums[held] = np.add.reduceat(mix(spread ^ np.uint64(_GOLDEN))[order], starts[held])
            # each subset leaves one cell out: what it holds is the part less that cell
            sums, counts = sums.reshape(parts, CELLS), counts.reshape(parts, CELLS)
            sums, counts = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums, counts.sum(axis=1, keepdims=True) - counts
            least = counts.min(axis=1)
            few = next((x for x in (2, 1) if (least < x).sum() <= spare), 0)
            names = (np.arange(cells, dtype=np.uint64) + np.uint64(band << 32)).reshape(parts, CELLS)
            out.append(mix(mix(names) + sums)[counts >= few])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def bins_of(features: np.ndarray) -> bytes:
    """How many features fall in each of the bins; differences add up to a lower bound of the Hamming distance.

    A larger set has more bins, as few would even out what differs. Fewer bins are sums of more: bin i of w is in bin i % v of v.
    """
    width = BINS
    while width < MOST_BINS and 2 * width < len(features):
        width *= 2
    return np.minimum(np.bincount((mix(features) % np.uint64(width)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def folded(bins: list[bytes], width: int) -> np.ndarray:
    """The bins of sets as rows of one width, which none of them is under."""
    own = np.fromiter(map(len, bins), dtype=np.int64, count=len(bins))
    out = np.empty((len(bins), width), dtype=np.int16)
    for w in np.unique(own).tolist():
        at = np.flatnonzero(own == w)
        out[at] = np.frombuffer(b"".join(bins[i] for i in at.tolist()), dtype=np.uint8).reshape(len(at), w // width, width).sum(axis=1, dtype=np.int16)
    return out


def bin_distances(p: list[bytes], q: list[bytes]) -> np.ndarray:
    """The lower bounds of the distances of pairs of sets, given their bins."""
    width = np.fromiter((min(len(x), len(y)) for x, y in zip(p, q, strict=True)), dtype=np.int64, count=len(p))
    out = np.zeros(len(p), dtype=np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.abs(folded([p[i] for i in at.tolist()], w) - folded([q[i] for i in at.tolist()], w)).sum(axis=1, dtype=np.int64)
    return out


def node_of(features: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    with np.errstate(over="ignore"):
        return int((mix(features).sum(dtype=np.uint64) + np.uint64(len(features) * _GOLDEN & (1 << 64) - 1)).astype(np.int64))


SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bins", T.BinaryType())])
BLOBS = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("sigs", "nodes", "link_sigs", "link_nodes", "link_pivots"))])
STARS = T.StructType([T.StructField("sig", T.LongType()), T.StructField("node", T.LongType()), T.StructField("pivot", T.LongType())])


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node, bins of each row; node and bins are null where a text has no words."""

    def make() -> Callable:
        shingler = Shingler(words)

        def work(batch):
            sets = shingler.sets(texts_of(batch))
            yield {"doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "node": [node_of(s) if len(s) else None for s in sets], "bins": [bins_of(s) if len(s) else None for s in sets]}

        return work

    return map_batches(docs, make, SETS)


def _cut(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in a sorted column of bucket numbers."""
    return np.searchsorted(bucket, np.arange(buckets + 1))


def signed_stars(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """(sig, node, pivot): nodes that share a signature with a smaller node, the pivot.

    A signature is named by its bucket (its upper bits) and the lower half of its hash; should two fall together, the pairs are
    verified like any others. The smallest node of a signature in a slice goes to the signature's bucket; the others of the slice are linked
    to it at once, and those links are dealt by the pair. A task signs a set once while it remembers it.
    """

    def deal() -> Callable:
        shingler, signer, seen = Shingler(words), Signer(percent), set()
        none = np.zeros(0, dtype=np.int64)

        def work(batch):
            sigs, nodes = [], []
            for s in shingler.sets(texts_of(batch)):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                own = signer.signatures(s)
                sigs.append(own)
                nodes.append(np.full(len(own), node, dtype=np.int64))
            if not sigs:
                return
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            del sigs, nodes
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, dtype=bool)
            pivot = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
            home = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            name = home << 32 | (sig & np.uint64(0xFFFFFFFF)).astype(np.int64)
            linked = ~first & (node != pivot)
            to = ((mix(mix(node[linked].view(np.uint64)) + pivot[linked].view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            turn = to.argsort(kind="stable")
            links = [x[linked][turn] for x in (name, node, pivot)]
            low, own = (name[first] & 0xFFFFFFFF).astype("<u4"), node[first]
            cuts, ends = _cut(home[first], buckets), _cut(to[turn], buckets)
            out: dict[str, list] = {n: [] for n in BLOBS.names}
            for b in np.flatnonzero((cuts[1:] > cuts[:-1]) | (ends[1:] > ends[:-1])).tolist():
                mine, theirs = slice(cuts[b], cuts[b + 1]), slice(ends[b], ends[b + 1])
                for n, v in zip(BLOBS.names, (b, low[mine].tobytes(), own[mine].tobytes(), *((x[theirs] if len(x) else none).tobytes() for x in links)), strict=True):
                    out[n].append(v)
            yield out

        return work

    def gather() -> Callable:
        held: list[dict] = []

        def flush():
            if held:
                yield _stars(held)
                held.clear()

        def work(batch):
            for blob in batch.to_pylist():
                if held and held[0]["bucket"] != blob["bucket"]:
                    yield from flush()
                held.append(blob)

        work.finish = flush
        return work

    dealt = map_batches(docs, deal, BLOBS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, gather, STARS)


def _stars(blobs: list[dict]) -> dict:
    """The stars of a bucket: each signature's nodes with the smallest of them, and the links that the slices had made."""
    sig, node = (np.concatenate([np.frombuffer(b[n], kind) for b in blobs]) for n, kind in (("sigs", "<u4"), ("nodes", "<i8")))
    links = [np.concatenate([np.frombuffer(b[n], "<i8") for b in blobs]) for n in ("link_sigs", "link_nodes", "link_pivots")]
    order = sig.argsort()
    ordered = sig[order]
    same = ordered[1:] == ordered[:-1]
    take = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    sig, node = sig[take], node[take]  # what is met once is gone
    if len(sig):
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        pivot = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
        keep = node != pivot
        links = [np.concatenate(x) for x in zip(links, (sig[keep].astype(np.int64) | blobs[0]["bucket"] << 32, node[keep], pivot[keep]), strict=True)]
    return {n: pa.array(x) for n, x in zip(STARS.names, links, strict=True)}


def fine_of(features: np.ndarray) -> bytes:
    """Like bins_of, in eight times as many bins of 4 bits."""
    counts = np.minimum(np.bincount((mix(features ^ np.uint64(_GOLDEN)) % np.uint64(FINE)).astype(np.int64), minlength=FINE), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, features), a table, are similar enough.

    A finer lower bound of the distance goes first, so that whole sets go with few pairs that aren't.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    sketch = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fine", T.BinaryType())])

    def both(rows: DataFrame, side: DataFrame) -> DataFrame:
        a, b = (side.toDF(*(x if c == "node" else f"{c}{x}" for c in side.columns)) for x in "ab")
        return rows.join(a, "a").join(b, "b")

    def sketched() -> Callable:
        def work(batch):
            own = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("features")]
            yield {"node": batch.column("node"), "n": [len(x) for x in own], "fine": [fine_of(x) for x in own]}

        return work

    def near() -> Callable:
        def work(batch):
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, FINE // 2).astype(np.int16) for c in ("finea", "fineb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            distance = np.abs((p & 15) - (q & 15)).sum(axis=1, dtype=np.int64) + np.abs((p >> 4) - (q >> 4)).sum(axis=1, dtype=np.int64)
            mask = pa.array(close_enough(na, nb, distance, percent))
            yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        return work

    def compare() -> Callable:
        def work(batch):
            good = []
            for x, y in zip(batch.column("featuresa"), batch.column("featuresb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(good, pa.bool_())
            yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        return work

    likely = written(map_batches(both(pairs, map_batches(sets, sketched, sketch)), near, schema), "near")
    return map_batches(both(likely, sets), compare, schema)


def close_enough(na: np.ndarray, nb: np.ndarray, distance: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and a lower bound of the Hamming distance allow the similarity."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * distance <= (100 - percent) * (na + nb))


def pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bin counts don't rule out."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "binsa", "binsb")

    def make() -> Callable:
        def work(batch):
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            mask = pa.array(close_enough(na, nb, bin_distances(*(batch.column(c).to_pylist() for c in ("binsa", "binsb"))), percent))
            yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        return work

    return map_batches(both, make, schema)


def across(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a signature and lie in different components, in blocks, pruned. members: (sig, node, component), a table.

    A node brings its KNOWN smallest signatures along. A pair is passed over where both have one that is smaller than the group's, as it is met there; under the
    smallest that they share it never is.
    """
    sizes = members.groupBy("sig").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    small = members.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, KNOWN).alias("known"))
    rows = members.join(sizes.where("m > 2"), "sig").join(nodes.select("node", "n", "bins"), "node").join(small, "node").withColumn("_blocks", blocks)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    # a block meets itself and the others once: the pair of blocks is the key
    met = rows.select("sig", "node", "component", "n", "bins", "known", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    keyed = met.select("sig", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), "node", "component", "n", "bins", "known", "_own")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def make() -> Callable:
        held: list[pa.RecordBatch] = []  # the last group, which may go on in the next batch

        def done(rows: pa.Table) -> dict:
            """The pairs of the groups in rows, all of which are whole."""
            columns = {c: rows.column(c).to_numpy() for c in ("sig", "x", "y", "node", "component", "n", "_own")}
            bins, known = rows.column("bins").to_pylist(), _known(rows.column("known").combine_chunks(), columns["sig"])
            starts = _starts(columns)
            found = [_group_pairs({c: v[i:j] for c, v in columns.items()}, bins[i:j], known[i:j], percent) for i, j in zip(starts, [*starts[1:], rows.num_rows], strict=True)]
            return {n: np.concatenate([f[k] for f in found]) for k, n in enumerate("ab")}

        def work(batch):
            rows = pa.Table.from_batches([*held, batch])
            last = _starts({c: rows.column(c).to_numpy() for c in ("sig", "x", "y")})[-1]
            held[:] = rows.slice(last).to_batches()
            if last:
                yield done(rows.slice(0, last))

        def rest():
            if held:
                yield done(pa.Table.from_batches(held))
                held.clear()

        work.finish = rest
        return work

    dealt = keyed.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return map_batches(dealt, make, schema).distinct()  # of a pair's signatures the smallest may not be known


def _starts(columns: dict[str, np.ndarray]) -> list[int]:
    """Where the groups of sorted (sig, x, y) begin."""
    sig, x, y = (columns[c] for c in ("sig", "x", "y"))
    return [0, *(np.flatnonzero((sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()]


def _known(lists: pa.ListArray, sig: np.ndarray) -> np.ndarray:
    """The known signatures that are smaller than the row's own, KNOWN in a row, with -1 for none."""
    counts = lists.value_lengths().to_numpy()
    out = np.full((len(counts), KNOWN), -1, dtype=np.int64)
    out[np.arange(KNOWN) < counts[:, None]] = lists.flatten().to_numpy()
    out[out >= sig[:, None]] = -1
    return out


def _group_pairs(columns: dict[str, np.ndarray], bins: list[bytes], known: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one pair of blocks: sizes, components and bins allow them, and no smaller signature is known to have them."""
    node, comp, n, own = (columns[c] for c in ("node", "component", "n", "_own"))
    x, y = columns["x"][0], columns["y"][0]
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    right = right[np.argsort(n[right], kind="stable")]  # partners of a size are next to each other
    low = np.searchsorted(n[right], -(-n[left] * percent // 100))
    count = np.searchsorted(n[right], n[left] * 100 // percent, side="right") - low
    ends = count.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    matrix = folded(bins, min(map(len, bins))) if total else None
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, total, STEP):
        place = np.arange(at, min(at + STEP, total))
        who = np.searchsorted(ends, place, side="right")
        i, j = left[who], right[low[who] + place - (ends - count)[who]]
        keep = (comp[i] != comp[j]) & ((node[j] > node[i]) | (x != y))
        i, j = i[keep], j[keep]
        keep = close_enough(n[i], n[j], np.abs(matrix[i] - matrix[j]).sum(axis=1, dtype=np.int64), percent)
        i, j = i[keep], j[keep]
        keep = ~((known[i][:, :, None] == known[j][:, None, :]) & (known[i] >= 0)[:, :, None]).any(axis=(1, 2))
        a.append(np.minimum(node[i], node[j])[keep])
        b.append(np.maximum(node[i], node[j])[keep])
    return np.concatenate(a), np.concatenate(b)


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of word shingles (a text of fewer words is one
    shingle). component_id is the smallest doc_id reachable by links, the row's own included. Null and empty texts, and
    texts of white space, have no shingles and link with nothing: their component is their own id. Repeated rows are
    linked and stay; a null id stays null and names a component only if no other id is in it.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = written(shingle_sets(docs, words), "sets")
    nodes = written(sets.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("n_shingles").alias("n"), "bins")).alias("s"), F.count("*").alias("_m")).select("node", "s.doc_id", "s.n", "s.bins", "_m"), "nodes")
    live = written(signed_stars(docs, words, percent, max(8, nodes.count() // BUCKET_DOCS)), "live")
    found = live.groupBy("node", "pivot").agg(F.count("*").alias("shared"))
    stars = written(found.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "node", "shared").where("a != b"), "stars")
    likely = written(pruned(stars.select("a", "b").distinct(), nodes, percent), "pairs")
    wanted = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    features = written(feature_sets(docs, wanted, nodes, words), "features")
    best = stars.join(likely, ["a", "b"]).groupBy("node").agg(F.max(F.struct("shared", "a", "b")).alias("s")).select("s.a", "s.b").distinct()
    links = written(verified(best, features, percent), "links")
    groups = components(links)
    rest = outside(likely.join(best, ["a", "b"], "left_anti"), groups)
    links = written(links.unionByName(verified(rest, features, percent)), "links")
    groups = written(components(links), "groups")
    # signatures that still hold several components
    rows = live.select("sig", "node").unionByName(live.select("sig", F.col("pivot").alias("node"))).distinct().join(groups, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    several = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h")).where("lo != hi and m > 2")
    # signatures that hold the same nodes are one: the sum of the nodes' hashes tells
    mixed = several.groupBy("m", "h", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig")
    members = written(rows.join(mixed, "sig", "left_semi"), "members")
    left = written(across(members, nodes, percent).join(likely, ["a", "b"], "left_anti"), "across")
    if not left.isEmpty():
        more = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct().join(features, "node", "left_anti")
        features = features.unionByName(written(feature_sets(docs, more, nodes, words), "features"))
        groups = components(links.unionByName(verified(left, features, percent)))
    grouped = written(nodes.select("node", "doc_id").join(groups, "node"), "grouped")
    least = written(grouped.groupBy("component").agg(F.min("doc_id").alias("c"), F.count("*").alias("_m")), "least")
    linked = hot_join(grouped, least, "component").select("node", "c")
    names = written(nodes.select("node", "doc_id", "_m").join(linked, "node", "left").select("node", F.coalesce("c", "doc_id").alias("component_id"), "_m"), "names")
    lone = sets.where("node is null").withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return hot_join(sets, names, "node").select(*columns).unionByName(lone.select(*columns))


def one_of_each(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (a null id last, then the first in the table). Columns as they were.

    Rows are numbered in a written copy, so that every job sees the same numbers. Texts without words link with nothing and all stay.
    """
    plain = with_plain_names(docs)
    ids = plain.columns[docs.columns.index("doc_id")]
    rows = numbered(plain, "_row")
    found = jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), words, percent)
    found = written(found.join(rows.select(F.col("_row").alias("doc_id"), F.col(ids).alias("_id")), "doc_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("c"), "_id"), "groups")
    first = found.groupBy("c").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("s"), F.count("*").alias("_m")).where("_m > 1").select("c", F.col("s._row").alias("first"), "_m")
    others = hot_join(found, written(first, "first"), "c").where("_row != first").select("_row")
    return rows.join(others, "_row", "left_anti").select(*plain.columns).toDF(*docs.columns)


def outside(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs that lie in different components."""
    ends = groups.select(F.col("node").alias("a"), F.col("component").alias("ca")), groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")


def feature_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, features) of the wanted nodes, features as sorted 64-bit numbers, from one document of each."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("features", T.BinaryType())])
    one = nodes.join(wanted, "node", "left_semi").select("node", "doc_id")

    def make() -> Callable:
        shingler = Shingler(words)

        def work(batch):
            sets = shingler.sets(texts_of(batch))
            made = [node_of(s) if len(s) else None for s in sets]
            keep = [m == w for m, w in zip(made, batch.column("node").to_pylist(), strict=True)]  # rows that share an id may differ
            yield {"node": [m for m, k in zip(made, keep, strict=True) if k], "features": [s.tobytes() for s, k in zip(sets, keep, strict=True) if k]}

        return work

    texts = docs.join(one.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    return map_batches(texts, make, schema).dropDuplicates(["node"])
