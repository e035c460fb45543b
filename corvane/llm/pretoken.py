"""Exact token ids with each distinct chunk of text tokenized once per task.

A text is cut at places where the tokenizer itself always cuts, so that the ids
of a text are the ids of its chunks, one after the other. A batch of texts is one column of chunks: its distinct
chunks are found and cut into pieces as a column, the model is asked for each distinct piece that isn't known, and ids
are put in place by index. A task keeps the ids of the pieces it has met, up to a bound on entries; past the bound,
pieces are tokenized once per batch. The ids are those of the tokenizers library for the whole text: only the repeated work is saved.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space but blanks and line feeds: such texts are tokenized whole.
_OTHER_SPACE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *(i for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7))]))
_MARKS = ".,;:!?|%$#&*"
#: A word of Latin letters with marks after it, or none: the tokenizers here cut it in these two pieces,
#: so that its model can be asked for each piece and the library's rules for cutting needn't run.
_PLAIN = re.compile(f"( ?[{_LETTERS}]+)([{_MARKS}]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level BPE: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def _taken(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs of flat, which are as long as lengths says and follow one another, in the order of at."""
    held = lengths[at]
    ahead = (lengths.cumsum() - lengths)[at] - (held.cumsum() - held)
    return flat[np.repeat(ahead, held) + np.arange(held.sum())]


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    path: a tokenizers JSON file. keeps_space: True if the tokenizer's pieces
    contain the space before a word (byte-level BPE), False if white space is
    dropped and words are lower-cased. most: half the entries kept for the life of the encoder (about 200 bytes each).
    """

    def __init__(self, path: str, keeps_space: bool, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.most = keeps_space, most
        self.known: dict[str, bytes] = {"": b""}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _ids(self, texts: list[str]) -> Iterable[bytes]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for at in range(0, len(texts), 4096):
            for e in batch(texts[at : at + 4096], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of what is one pre-token for the library."""
        as_bytes = piece if piece.isascii() and " " not in piece else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces: letters (with the space before them if that is kept), marks, or whole chunks that aren't plain."""
        out = list(map(self.known.get, pieces))
        new = [p for p, ids in zip(pieces, out, strict=True) if ids is None]
        hard = [p for p in new if _PLAIN.fullmatch(p) is None]
        fresh = dict(zip(hard, self._ids(hard), strict=True))
        for p in new:
            if p not in fresh:
                fresh[p] = self._piece(p)
        got = map(fresh.__getitem__, new)
        out = [next(got) if ids is None else ids for ids in out]
        self.known.update(islice(fresh.items(), max(0, 2 * self.most - len(self.known))))
        return out

    def _chunks(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Runs of blanks and line feeds with the non-space runs that follow them, and where each text's begin and the last one's end."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, "<i4")[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(bounds[0]), int(bounds[-1])
        here = np.frombuffer(data, np.uint8)[low:high] if data else np.zeros(0, np.uint8)
        blank = (here == 0x20) | (here == 0x0A)
        edge = np.zeros(high - low + 1, dtype=bool)
        edge[1:-1] = blank[1:] & ~blank[:-1]
        edge[bounds - low] = True
        edges = np.flatnonzero(edge).astype(np.int32)
        return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges + np.int32(low)), data or pa.py_buffer(b"")), np.searchsorted(edges, bounds - low)

    def _words(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after the other, and how many each has."""
        if self.keeps_space:
            stems, marks = pc.utf8_rtrim(chunks, _MARKS), pc.utf8_ltrim(chunks, " " + _LETTERS)
            cut = pc.invert(pc.or_(pc.starts_with(stems, "  "), pc.equal(stems, " ")))  # a space belongs to the letters after it, and there is one at most
        else:
            chunks = pc.ascii_ltrim(chunks, " \n")
            stems, marks, cut = pc.utf8_rtrim(chunks, _MARKS), pc.utf8_ltrim(chunks, _LETTERS), True
        plain = pc.and_(cut, pc.equal(pc.add(pc.binary_length(stems), pc.binary_length(marks)), pc.binary_length(chunks)))  # letters, then marks, and nothing else
        stems = stems if self.keeps_space else pc.utf8_lower(stems)
        coded = pa.concat_arrays([pc.if_else(plain, stems, chunks), pc.if_else(plain, marks, "")]).dictionary_encode()
        ids = self._pieces(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        halves = coded.indices.to_numpy().reshape(2, -1).T  # of each chunk its letters and its marks
        return _taken(np.frombuffer(b"".join(ids), "<u4"), lengths, halves.ravel()), lengths[halves].sum(axis=1)

    def columns(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. Null reads as empty."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, _OTHER_SPACE)
        chunks, bounds = self._chunks(pc.if_else(odd, "", texts))
        coded = chunks.dictionary_encode()
        flat, lengths = self._words(coded.dictionary)
        at = coded.indices.to_numpy()
        ids = _taken(flat, lengths, at)
        ends = np.concatenate([[0], lengths[at].cumsum()])[bounds]
        counts = np.diff(ends)
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(where):
            whole = list(self._ids(texts.take(pa.array(where)).to_pylist()))
            counts[where] = [len(x) // 4 for x in whole]
            ids = np.insert(ids, np.repeat(ends[where], counts[where]), np.frombuffer(b"".join(whole), "<u4"))
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.columns(pa.array(texts, pa.string()))
        ends = counts.cumsum()
        return [ids[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def shared_encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """The encoder of this Python worker: a worker runs many tasks, and what one has met the next needn't tokenize again."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS.clear()  # one at a time, so that memory stays bounded
        _ENCODERS[key] = ChunkEncoder(path, keeps_space)
    return _ENCODERS[key]
