"""Token counts without ids of documents: pieces are counted once for each distinct pre-token.

A SentencePiece BPE model merges neighbours only into pieces of its vocabulary. Where no piece
has a space mark after another character, no merge crosses from a word to the
next space mark, so the text falls into pre-tokens (space marks and the word
after them) that are tokenized independently. A document's count is the sum over
its pre-token frequencies of pre-token counts.

1. A slice of documents becomes its distinct pre-tokens and a sparse matrix of frequencies by document. The pre-tokens
   are dealt to buckets by hash, a blob for each slice and bucket; the matrix stays with the slice.
2. A bucket counts the pieces of each of its distinct pre-tokens, once in the whole cluster, and answers each
   slice with the counts in the order in which it was asked. A pre-token that all documents have costs a bucket a line for each slice, not for each document.
3. A slice's answers meet its matrix: the product is the documents' counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from operator import mul

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches, texts_of, written

_RUNS = re.compile(r" *[^ ]+| +")
#: Documents that a bucket of pre-tokens stands for, about; rows of a slice at most, as they are numbered in 16 bits.
BUCKET_DOCS, SLICE_ROWS = 16384, 60_000


class PieceCounter:
    """Counts the pieces of texts for a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.whole = any(mark in p.lstrip(mark) for p in pieces)
        # probes show whether the model keeps spaces as they are and puts one before a text
        probes = ["a", " a", "a  b ", "   a b", "a\n b", "a   "]
        self.whole = self.whole or self.counts(probes) != self.count(probes)

    def count(self, texts: list[str]) -> list[int]:
        """Pieces of each text, or of each pre-token of bags()."""
        out: list[int] = []
        for at in range(0, len(texts), 8192):
            out += map(len, self.model.encode(texts[at : at + 8192], num_threads=1))
        return out

    def bags(self, texts: list[str]) -> list[Counter | None]:
        """How often each text has each pre-token; None for a text that must be counted whole.

        The model puts a space before what it encodes, so a pre-token's first one is cut off here; an empty pre-token is a space alone.
        """
        found: list[Counter | None] = []
        for t in texts:
            if self.whole or "▁" in t:  # that mark looks like a space to the model
                found.append(None)
            elif not t:
                found.append(Counter())
            elif "  " in t or t[0] == " " or t[-1] == " ":
                found.append(Counter([r[1:] for r in _RUNS.findall(" " + t)]))
            else:
                found.append(Counter(t.split(" ")))
        return found

    def pieces(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        return [n if p else 1 for p, n in zip(pretokens, self.count(pretokens), strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        """Pieces of each text by its pre-tokens: what the cluster does, in one place."""
        bags = self.bags(texts)
        each = sorted(set().union(*(b for b in bags if b is not None)))
        known = dict(zip(each, self.pieces(each), strict=True))
        return [self.count([t])[0] if b is None else sum(map(mul, map(known.__getitem__, b), b.values())) for t, b in zip(texts, bags, strict=True)]


_SLICE = ("docs", "none", "bytes", "whole", "sizes", "rows", "times", "many")
DEALT = T.StructType([T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("words", "ends", "counts", *_SLICE))])
COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _rows(schema: T.StructType, rows: list[dict]) -> dict:
    return {n: [r.get(n) for r in rows] for n in schema.names}


def dealt_pretokens(docs: DataFrame, model_path: str, buckets: int) -> DataFrame:
    """For each slice of documents (batch) a row with its matrix (bucket -1), and a row for each bucket with the slice's pre-tokens in it.

    The matrix goes by pre-token, in the order of bucket and place in it: sizes (documents of each), rows and times (up to 255;
    what is over that is in many, as pairs of place and times).
    """

    def make() -> Callable:
        from xxhash import xxh64_intdigest

        counter, made = PieceCounter(model_path), [0]

        def work(batch):
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield _rows(DEALT, one(batch.slice(at, SLICE_ROWS)))

        def one(part) -> list[dict]:
            texts = texts_of(part)
            bags = counter.bags(texts)
            number: dict[str, int] = {}
            for b in bags:
                for w in b or ():
                    if w not in number:
                        number[w] = len(number)
            sizes = [len(b) if b else 0 for b in bags]
            total = sum(sizes)
            word = np.fromiter((number[w] for b in bags if b for w in b), dtype=np.int64, count=total)
            times = np.fromiter((n for b in bags if b for n in b.values()), dtype=np.int64, count=total)
            row = np.repeat(np.arange(len(texts)), sizes)
            data = [w.encode() for w in number]  # in alphabetical order within a bucket, which packs better
            turn = sorted(range(len(data)), key=data.__getitem__)
            data = [data[i] for i in turn]
            home = np.fromiter((xxh64_intdigest(d) % buckets for d in data), dtype=np.int64, count=len(data))
            order = home.argsort(kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[np.array(turn, dtype=np.int64)[order]] = np.arange(len(order), dtype=np.int32)
            turn = rank[word].argsort(kind="stable")
            row, times = row[turn], times[turn]
            over = np.flatnonzero(times > 255)
            key = (TaskContext.get().partitionId() << 32) + made[0]
            made[0] += 1
            ids = part.column("doc_id")
            out = [{
                "batch": key, "bucket": -1, "docs": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "none": np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(),
                "bytes": np.array([len(t.encode()) for t in texts], dtype="<i8").tobytes(), "whole": np.array([counter.count([t])[0] if b is None else 0 for t, b in zip(texts, bags, strict=True)], dtype="<i8").tobytes(),
                "sizes": np.bincount(rank[word], minlength=len(order)).astype("<u2").tobytes(), "rows": row.astype("<u2").tobytes(), "times": np.minimum(times, 255).astype(np.uint8).tobytes(),
                "many": np.stack([over, times[over]]).astype("<i8").tobytes(),
            }]
            out[0] |= {n: _packed(out[0][n]) for n in _SLICE}
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                own = [data[i] for i in order[cuts[b] : cuts[b + 1]].tolist()]
                out.append({"batch": key, "bucket": b, "words": _packed(b"".join(own)), "ends": _packed(np.array([len(w) for w in own], dtype="<u4").tobytes())})
            return out

        return work

    return written(map_batches(docs, make, DEALT), "pretokens")


def counted_pretokens(dealt: DataFrame, model_path: str, buckets: int) -> DataFrame:
    """(batch, bucket, counts): each bucket's answer to each slice. A distinct pre-token is tokenized once."""
    schema = T.StructType([f for f in DEALT if f.name in ("batch", "bucket", "counts")])

    def make() -> Callable:
        counter, held = PieceCounter(model_path), []

        def flush():
            if not held:
                return
            asked = []
            for blob in held:
                ends = _numbers(blob["ends"], "<u4").cumsum().tolist()
                words = _numbers(blob["words"], np.uint8).tobytes()
                asked.append([words[a:b] for a, b in zip([0, *ends], ends)])
            each = list(set().union(*asked))
            known = dict(zip(each, counter.pieces([w.decode() for w in each]), strict=True))
            for blob, own in zip(held, asked, strict=True):
                yield {"batch": [blob["batch"]], "bucket": [blob["bucket"]], "counts": [_packed(np.fromiter(map(known.__getitem__, own), dtype="<u4", count=len(own)).tobytes())]}
            held.clear()

        def work(batch):
            for blob in batch.to_pylist():
                if held and held[0]["bucket"] != blob["bucket"]:
                    yield from flush()
                held.append(blob)

        work.finish = flush
        return work

    words = dealt.where("bucket >= 0").select("batch", "bucket", "words", "ends")
    return map_batches(words.repartition(buckets, "bucket").sortWithinPartitions("bucket"), make, schema)


def _summed(rows: list[dict]) -> dict:
    """The documents of a slice from its matrix and the buckets' answers."""
    own, answers = rows[0], [_numbers(r["counts"], "<u4") for r in rows[1:]]
    docs, none = _numbers(own["docs"], "<i8"), np.unpackbits(_numbers(own["none"], np.uint8)).astype(bool)
    times = _numbers(own["times"], np.uint8).astype(np.int64)
    at, many = _numbers(own["many"], "<i8").reshape(2, -1)
    times[at] = many
    sizes = _numbers(own["sizes"], "<u2")
    pieces = np.concatenate([*answers, np.zeros(0, dtype=np.uint32)]).astype(np.int64)
    if len(pieces) != len(sizes):
        raise ValueError("a slice lacks answers")
    n = np.bincount(_numbers(own["rows"], "<u2"), weights=np.repeat(pieces, sizes) * times, minlength=len(docs)).astype(np.int64)
    return {"doc_id": pa.array(docs, mask=none[: len(docs)]), "n_bytes": pa.array(_numbers(own["bytes"], "<i8")), "n_tokens": pa.array(n + _numbers(own["whole"], "<i8"))}


def count_tokens(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every row.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows are counted each; other columns are not read; an empty table gives no rows.
    A text that holds the model's space mark is counted whole, and so is every text for a model whose pieces cross spaces.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = max(8, rows.count() // BUCKET_DOCS)
    dealt = dealt_pretokens(rows, model_path, buckets)
    answers = counted_pretokens(dealt, model_path, buckets)
    both = dealt.where("bucket = -1").select("batch", "bucket", "counts", *_SLICE).unionByName(answers, allowMissingColumns=True)

    def make() -> Callable:
        held: list[dict] = []

        def flush():
            if held:
                yield _summed(held)
                held.clear()

        def work(batch):
            for row in batch.to_pylist():
                if held and held[0]["batch"] != row["batch"]:
                    yield from flush()
                held.append(row)

        work.finish = flush
        return work

    counted = map_batches(both.repartition(buckets, "batch").sortWithinPartitions("batch", "bucket"), make, COUNTS)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
