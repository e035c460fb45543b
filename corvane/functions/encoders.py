"""Deterministic stand-ins for hosted encoders, and hashing that Spark lacks, as Arrow UDFs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.stem import stem_english, stem_russian

_CYRILLIC = re.compile("[а-яё]")
VOCABULARY = 1 << 20
#: Terms whose names a task remembers, and bytes of term arrays that it counts at once.
REMEMBERED, SLICE = 200_000, 8 << 20


def stem_word(term: str) -> str:
    """Russian where a term has a Cyrillic letter, else English."""
    return stem_russian(term) if _CYRILLIC.search(term) else stem_english(term)


def place_of(term: str, vocabulary: int = VOCABULARY) -> int:
    """BLAKE2b of four bytes, big-endian, modulo the vocabulary's size."""
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=4).digest(), "big") % vocabulary


def term_index(term: Column, vocabulary: int = VOCABULARY) -> Column:
    """The place of a term in the hashed vocabulary."""

    @F.pandas_udf("long")
    def hashed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else place_of(x, vocabulary))

    return hashed(term)


def counted(terms: Column, name: Callable[[str], object] | None, kind: T.DataType, most: int | None = None) -> Column:
    """How often each name occurs in an array of terms: an array of (term, tf) structs. Terms of the same name add up; null and empty arrays give an empty one.

    Each array is counted where it stands, so terms are neither joined nor shuffled. A task remembers the names of at most REMEMBERED terms.
    Without a function `name` a term is its own name. With `most` only so many of the most frequent names are given, by frequency, then name.
    """
    fields = T.ArrayType(T.StructType([T.StructField("term", kind), T.StructField("tf", T.LongType())]))
    target = to_arrow_type(fields)

    def count(part: pa.Array, known: dict) -> pa.Array:
        lengths = np.diff(part.offsets.to_numpy()) if not part.null_count else pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        coded = part.flatten().dictionary_encode()
        if name is None:
            distinct = coded
        else:
            names = []
            for term in coded.dictionary.to_pylist():
                if term not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[term] = name(term)
                names.append(known[term])
            distinct = pa.array(names, target.value_type.field(0).type).dictionary_encode()
        dictionary = distinct.dictionary
        code = (coded.indices.to_numpy() if name is None else distinct.indices.to_numpy()[coded.indices.to_numpy()]).astype(np.int64)
        base = max(1, len(dictionary))
        if most is not None:  # codes in the names' order
            order = pc.sort_indices(dictionary).to_numpy().astype(np.int64)
            code, dictionary = np.argsort(order)[code], dictionary.take(pa.array(order))
        keys, tf = np.unique(np.repeat(np.arange(len(part), dtype=np.int64), lengths) * base + code, return_counts=True)
        if most is not None:
            row = keys // base
            order = np.lexsort((keys, -tf, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < most]
            keys, tf = keys[order], tf[order]
        offsets = np.searchsorted(keys // base, np.arange(len(part) + 1, dtype=np.int64)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([dictionary.take(pa.array(keys % base)), pa.array(tf, pa.int64())], fields=list(target.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(target)

    @F.arrow_udf(fields)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict = {}
        for batch in batches:
            step = max(1, int(len(batch) * SLICE / max(SLICE, batch.nbytes)))
            parts = [count(batch.slice(at, step), known) for at in range(0, len(batch), step)]
            yield pa.concat_arrays(parts) if parts else pa.array([], target)

    return run(terms)


def _seed(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def pseudo_vector(text: str, dimension: int) -> list[float]:
    """A unit vector from a linear congruential sequence that the text seeds."""
    state, out = _seed(text) or 1, []
    for _ in range(dimension):
        state = (1103515245 * state + 12345) % (1 << 31)  # fixed values of the generator
        out.append(state / ((1 << 31) - 1) - 0.5)
    v = np.array(out)
    return (v / (np.sqrt((v * v).sum()) or 1.0)).tolist()


def dense_encoder(dimension: int):
    """A column function from text to a dense vector. A hosted model takes its place with the same signature."""

    @F.pandas_udf("array<double>")
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else pseudo_vector(t, dimension))

    return encode


def sparse_place(token: Column | str, vocabulary: int = 4096) -> Column:
    """The place of a token in the small sparse vocabulary."""

    @F.pandas_udf("long")
    def place(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else _seed(x) % vocabulary)

    return place(token)
