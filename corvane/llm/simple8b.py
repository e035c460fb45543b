"""Token-id files in Simple-8b: a selector packs a varying count of ids in each 64-bit word.

A file holds a run of documents in ascending doc_id order (null ids first):

    magic 8 bytes | uint32 documents, blocks, ids in a block, 0 | uint64 ids, words, escapes
    int64 doc_id of each document (0 where null) | uint8 flag of each: 1 where its id is null, padded to 8 bytes
    uint64 ids of each document
    uint64 [blocks + 1] first word of each block | uint64 [blocks + 1] first escape of each block
    uint64 words | uint64 escape places (in the file's ids) | uint64 escaped values

The low 60 bits of a word hold its values, the high 4 its selector. In each block,
values too wide for the width that makes the block smallest are escaped: 0 stands
in the word and the value in the escape list. Blocks start with a word of their
own, so that any block can be decoded alone; all words of a selector are decoded at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches, scratch_dir, written
from corvane.llm.pretoken import shared_encoder

MAGIC = b"CVS8B01\n"
BLOCK = 8192
#: Runs at most, as each has a bound on the driver; larger runs are written in more parts.
MOST_RUNS = 20_000
#: (values in a word, bits of a value) by selector; the format's fixed table.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS, _BITS = np.array(SELECTORS).T
_WIDTHS = sorted({b for _, b in SELECTORS if b})


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < 1 << 53:  # a double's exponent says it
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    bits = np.zeros(len(values), dtype=np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = (values >> (bits.astype(np.uint64) + np.uint64(shift))) > 0
        bits += (high * shift).astype(np.uint8)
    return bits + (values > 0)


def _cut(bits: np.ndarray) -> int:
    """The width over which values are escaped: the one that makes the block smallest."""
    count = np.bincount(bits, minlength=65)
    over = count[::-1].cumsum()[::-1]
    words = {b: -(-len(bits) // n) for n, b in SELECTORS if b}
    return min(_WIDTHS, key=lambda b: (8 * words[b] + 16 * int(over[b + 1]) if b < 64 else 0, b))


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, places of escapes, escaped values) of unsigned 64-bit values."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return values, values.astype(np.int64), values
    bits = _bit_lengths(values)
    cut = _cut(bits)
    escaped = np.flatnonzero(bits > cut)
    kept = values.copy()
    kept[escaped] = 0
    bits[escaped] = 0
    # widest value of the window of each length that starts at each place; past the end nothing is wide
    padded = np.concatenate([bits, np.zeros(240, dtype=np.uint8)])
    best = np.zeros(n, dtype=np.uint8)
    power, span = padded, 1
    spans = {1: power}
    while span < 128:
        power = np.concatenate([np.maximum(power[:-span], power[span:]), power[-span:]])
        span *= 2
        spans[span] = power
    for count, width in SELECTORS:  # what doesn't fit a selector doesn't fit those before it
        base = 1 << (count.bit_length() - 1)
        best += np.maximum(spans[base][:n], spans[base][count - base : count - base + n]) > width
    jump, starts, at = _COUNTS[best].astype(np.uint8).tobytes(), [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    where = np.array(starts)
    chosen = best[where]
    held = np.diff(where, append=n)
    shift = (np.arange(n) - np.repeat(where, held)) * np.repeat(_BITS[chosen], held)
    words = chosen.astype(np.uint64) << np.uint64(60) | np.bitwise_or.reduceat(kept << shift.astype(np.uint64), where)
    return words, escaped, values[escaped]


def decode_words(words: np.ndarray, total: int) -> np.ndarray:
    """The first total values of consecutive words of one block, escapes not yet put in."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts, width = _COUNTS[selector], _BITS[selector]
    starts = counts.cumsum() - counts
    shift = (np.arange(counts.sum()) - np.repeat(starts, counts)) * np.repeat(width, counts)
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    out = (np.repeat(words, counts) >> shift.astype(np.uint64)) & np.repeat(mask, counts)
    return out[:total]


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file of documents, given in the order in which they are stored."""
    lengths = np.array([len(x) for x in ids], dtype="<u8")
    values = np.concatenate([np.asarray(x, dtype=np.uint64) for x in ids]) if ids else np.zeros(0, dtype=np.uint64)
    words, places, escapes, first_word, first_escape = [], [], [], [0], [0]
    for at in range(0, len(values), BLOCK):
        w, p, e = encode_block(values[at : at + BLOCK])
        words.append(w)
        places.append(p + at)
        escapes.append(e)
        first_word.append(first_word[-1] + len(w))
        first_escape.append(first_escape[-1] + len(p))
    join = lambda parts: np.concatenate([np.asarray(x, dtype="<u8") for x in parts]).tobytes() if parts else b""
    flags = bytes(x is None for x in doc_ids)
    return b"".join([
        MAGIC, np.array([len(ids), len(words), BLOCK, 0], dtype="<u4").tobytes(), np.array([len(values), first_word[-1], first_escape[-1]], dtype="<u8").tobytes(),
        np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), flags + bytes(-len(flags) % 8), lengths.tobytes(),
        np.array(first_word, dtype="<u8").tobytes(), np.array(first_escape, dtype="<u8").tobytes(), join(words), join(places), join(escapes),
    ])


def decode_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document as lengths, all ids) of a file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, blocks, block, _ = np.frombuffer(data, "<u4", 4, 8).tolist()
    total, n_words, n_escapes = np.frombuffer(data, "<u8", 3, 24).tolist()
    at = 48

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    ids, flags = take("<i8", docs), take("u1", docs + -docs % 8)[:docs]
    lengths, first_word, first_escape = take("<u8", docs), take("<u8", blocks + 1), take("<u8", blocks + 1)
    words, places, escapes = take("<u8", n_words), take("<u8", n_escapes), take("<u8", n_escapes)
    if at != len(data) or int(lengths.sum()) != total or (blocks and int(first_word[-1]) != n_words) or int(first_escape[-1]) != n_escapes:
        raise ValueError("the file's lengths disagree")
    parts = [decode_words(words[int(first_word[b]) : int(first_word[b + 1])], min(block, total - b * block)) for b in range(blocks)]
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    values[places.astype(np.int64)] = escapes
    return [None if f else i for i, f in zip(ids.tolist(), flags.tolist(), strict=True)], lengths.astype(np.int64), values


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a file under another name and move it into place, so that a lost or repeated task leaves no half file."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        out.write(data)
    where.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


MANIFEST = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])
DECODED = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, run_rows: int = 4096, file_ids: int = 2_000_000) -> DataFrame:
    """Tokenize docs (doc_id, text) and write their ids as files in ascending doc_id order.

    Returns the manifest (run, part, file, docs, ids): runs and their parts are in doc_id order.
    Bounds of the runs come from the doc_id column alone, about run_rows documents a run; a run of
    very long documents is written in parts of at most about file_ids ids. Null text: the end id alone.
    Null ids come first. Rows that share a doc_id go to one run, each as a document of its own.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = keys.count()
    runs = max(1, min(-(-rows // run_rows), MOST_RUNS))
    cuts = keys.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], max(10_000, 20 * runs)).alias("c")).first()["c"] if runs > 1 else []
    bounds = np.array(sorted(set(cuts or [])), dtype=np.int64)  # one number for each run
    held = docs.sparkSession.sparkContext.broadcast(bounds)
    coded = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def tokenize() -> Callable:
        encoder, cut = shared_encoder(tokenizer_path, keeps_space=False), held.value

        def work(batch):
            ids = batch.column("doc_id").to_pylist()
            run = np.searchsorted(cut, np.array([np.iinfo(np.int64).min if i is None else i for i in ids], dtype=np.int64), side="right").astype(np.int32)
            values, counts = encoder.columns(batch.column("text"))
            values = np.insert(values, counts.cumsum(), end_id)
            yield {"run": pa.array(run), "doc_id": ids, "ids": list(map(_narrow, np.split(values, (counts + 1).cumsum()[:-1])))}

        return work

    def write() -> Callable:
        state: dict = {"run": None, "part": 0, "docs": [], "ids": [], "n": 0}

        def flush() -> Iterator[dict]:
            if state["docs"]:
                name = f"run-{state['run']:09d}-{state['part']:05d}.s8b"
                path = _put(folder, name, encode_file(state["docs"], state["ids"]))
                yield {"run": [state["run"]], "part": [state["part"]], "file": [path], "docs": [len(state["docs"])], "ids": [state["n"]]}
                state.update(part=state["part"] + 1, docs=[], ids=[], n=0)

        def work(batch):
            for run, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("run", "doc_id", "ids")), strict=True):
                if run != state["run"] or state["n"] > file_ids:
                    yield from flush()
                    if run != state["run"]:
                        state.update(run=run, part=0)
                values = _wide(ids)
                state["docs"].append(doc)
                state["ids"].append(values)
                state["n"] += len(values)

        work.finish = flush
        return work

    tokens = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), tokenize, coded)
    dealt = tokens.repartition(runs, "run").sortWithinPartitions("run", F.col("doc_id").asc_nulls_first())
    return written(map_batches(dealt, write, MANIFEST), "manifest")


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers where they fit, after a byte that says so: half the shuffle."""
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files of a manifest.

    The files are read by Spark's binary reader, so they may lie in any store that Spark reads.
    """
    spark = manifest.sparkSession
    ahead = Window.orderBy("run", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.withColumn("name", F.element_at(F.split("file", "/"), -1)).withColumn("_base", F.coalesce(F.sum("ids").over(ahead), F.lit(0)))  # a row for each file
    first = manifest.first()
    if first is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    folder = first["file"].rsplit("/", 1)[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "run-*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def decode() -> Callable:
        def work(batch):
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                docs, lengths, values = decode_file(data.as_py())
                ids, ends = values.astype("<u4").tobytes(), lengths.cumsum()
                place = ends - lengths
                yield {"file": [name] * len(docs), "doc_id": docs, "place": pa.array(place), "n_tokens": pa.array(lengths), "ids_crc32": [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(place.tolist(), ends.tolist(), strict=True)]}

        return work

    rows = map_batches(files, decode, DECODED)
    return rows.join(base.select(F.col("name").alias("file"), "_base"), "file").select("doc_id", (F.col("_base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs as token-id files in a scratch folder and read the documents back from them."""
    folder = f"{scratch_dir(docs.sparkSession, 'tokens')}/files"
    return read_token_files(write_token_files(docs, tokenizer_path, end_id, folder))
