"""Media columns: what bytes really are, from signatures that validators confirm.

An Aho-Corasick automaton finds all magic bytes in one pass over the bytes. Each hit
goes to its format's validator, which checks the structure and works out the length; hits that fail
are dropped. A value whose start holds a valid medium gets that type, whatever was
declared; valid media further inside are carved. Inside a confirmed container (samples, streams or members that are stored as they are)
the search goes on, and a medium there must end where its container does at the latest; inside compressed media it doesn't.
The same pass finds the formats' end marks, so that a validator looks an end up instead of searching for it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import cached_property
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches, texts_of, written

UNKNOWN = "application/octet-stream"


class Marks:
    """Where the end marks of a value are, in order."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[bytes, list[int]] = {}

    def first(self, mark: bytes, at: int) -> int:
        """The first place of a mark from `at` on, or -1."""
        own = self.places.get(mark, [])
        i = bisect_left(own, at)
        return own[i] if i < len(own) else -1

    def last(self, mark: bytes, at: int, before: int) -> int:
        """The last place of a mark from `at` up to `before`, or -1."""
        own = self.places.get(mark, [])
        i = bisect_left(own, before) - 1
        return own[i] if i >= 0 and own[i] >= at else -1

    @cached_property
    def zips(self) -> dict[int, int]:
        """Where each archive ends, by its start: an end record says where its directory and with it the archive begins."""
        found: dict[int, int] = {}
        for end in self.places.get(b"PK\x05\x06", []):
            if end + 22 > len(self.data):
                continue
            size, start, note = struct.unpack_from("<IIH", self.data, end + 12)
            at = end - size - start
            if at >= 0 and end + 22 + note <= len(self.data) and self.data[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                found[at] = end + 22 + note
        return found


def _riff(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """RIFF: the size field, the form and the chunk chain must agree."""
    if len(data) - at < 12:
        return None
    size = struct.unpack_from("<I", data, at + 4)[0]
    end = at + 8 + size
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(data[at + 8 : at + 12])
    if kind is None or size < 4 or end > len(data):
        return None
    place, seen = at + 12, set()
    while place + 8 <= end:
        seen.add(data[place : place + 4])
        step = struct.unpack_from("<I", data, place + 4)[0]
        place += 8 + step + (step & 1)
    if place not in (end, end + 1) or not seen or kind == "audio/wav" and not {b"fmt ", b"data"} <= seen:
        return None
    return end - at, kind


def _png(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """PNG: header chunk first, each chunk's checksum right, up to the end chunk."""
    place, first = at + 8, True
    while place + 12 <= len(data):
        size = struct.unpack_from(">I", data, place)[0]
        name, end = data[place + 4 : place + 8], place + 12 + size
        if end > len(data) or first and (name != b"IHDR" or size != 13) or zlib.crc32(data[place + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if name == b"IEND":
            return end - at, "image/png"
        place, first = end, False
    return None


def _gif(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """GIF: screen descriptor, then blocks up to the trailer, with an image at least."""
    if len(data) - at < 14:
        return None
    packed, place, images = data[at + 10], at + 13, 0
    if packed & 0x80:
        place += 3 << ((packed & 7) + 1)
    while place < len(data):
        mark = data[place]
        if mark == 0x3B:
            return (place + 1 - at, "image/gif") if images else None
        if mark == 0x21:
            place += 2
        elif mark == 0x2C:
            if place + 10 >= len(data):
                return None
            packed = data[place + 9]
            place += 11 + (3 << ((packed & 7) + 1) if packed & 0x80 else 0)
            images += 1
        else:
            return None
        while place < len(data) and data[place]:
            place += data[place] + 1
        place += 1
    return None


def _jpeg(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """JPEG: segments with lengths, a frame and a scan, up to the end marker."""
    place, frame = at + 2, False
    while place + 4 <= len(data):
        if data[place] != 0xFF:
            return None
        mark = data[place + 1]
        if mark == 0xFF:
            place += 1
            continue
        if mark == 0xD9 or mark < 0xC0:
            return None
        size = struct.unpack_from(">H", data, place + 2)[0]
        if size < 2:
            return None
        frame |= mark in (0xC0, 0xC1, 0xC2)
        place += 2 + size
        if mark == 0xDA:
            end = marks.first(b"\xff\xd9", place)
            return (end + 2 - at, "image/jpeg") if frame and end >= 0 else None
    return None


def _bmp(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """BMP: file size, pixel offset, header size, planes and depth must be possible together."""
    if len(data) - at < 30:
        return None
    size, zero, start, head = struct.unpack_from("<IIII", data, at + 2)
    planes, depth = struct.unpack_from("<HH", data, at + 26)
    ok = not zero and head in (40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(data) - at and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return (size, "image/bmp") if ok else None


def _pdf(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """PDF: a version, a cross-reference place and an end mark after it: the last one before the next header, as updates are appended."""
    if not data[at + 5 : at + 6].isdigit():
        return None
    after = marks.first(b"%PDF-", at + 1)
    end = marks.last(b"%%EOF", at, after if after >= 0 else len(data))
    start = marks.first(b"startxref", at)
    return (end + 5 - at, "application/pdf") if 0 <= start < end else None


def _zip(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """ZIP: an end record's directory must lie where it says, in an archive that begins here."""
    end = marks.zips.get(at)
    return (end - at, "application/zip") if end is not None else None


def _gzip(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """gzip: it must inflate, checksum included; the inflated bytes are dropped as they come."""
    if len(data) - at < 18 or data[at + 3] & 0xE0:
        return None
    stream, place = zlib.decompressobj(31), at
    try:
        while not stream.eof and place < len(data):
            rest = data[place : place + 65536]
            place += len(rest)
            while rest and not stream.eof:
                stream.decompress(rest, 1 << 20)
                rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return (place - len(stream.unused_data) - at, "application/gzip") if stream.eof else None


def _flac(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """FLAC: the stream-info block, 34 bytes long, comes first. It runs to the end of the value."""
    ok = len(data) - at >= 42 and data[at + 4] & 0x7F == 0 and int.from_bytes(data[at + 5 : at + 8], "big") == 34
    return (len(data) - at, "audio/flac") if ok else None


def _ogg(data: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """Ogg: pages one after the other, each of version 0 with its segment table."""
    place = at
    while data[place : place + 4] == b"OggS":
        if place + 27 > len(data) or data[place + 4]:
            return None
        segments = data[place + 26]
        step = 27 + segments + sum(data[place + 27 : place + 27 + segments])
        if place + step > len(data):
            return None
        place += step
    return (place - at, "audio/ogg") if place > at else None


#: Magic bytes of the formats, with their validators.
SIGNATURES: dict[bytes, Callable[[bytes, int, Marks], tuple[int, str] | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"%PDF-": _pdf,
    b"PK\x03\x04": _zip,
    b"\x1f\x8b\x08": _gzip,
    b"fLaC": _flac,
    b"OggS": _ogg,
}


#: Marks that validators look up, besides headers.
ENDS = (b"\xff\xd9", b"startxref", b"%%EOF", b"PK\x05\x06")
#: Types that hold other bytes as they are.
CONTAINERS = frozenset(("audio/wav", "video/avi", "application/pdf", "application/zip"))


class Sniffer:
    """Finds and confirms media in bytes. Made once in a task."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic in (*SIGNATURES, *ENDS):
            self.automaton.add_word(magic.decode("latin-1"), magic)
        self.automaton.make_automaton()

    def find(self, data: bytes) -> list[tuple[int, int, str, int]]:
        """(start, length, type, depth) of confirmed media, in order of start. The depth is how many confirmed containers hold it."""
        marks, hits = Marks(data), []
        for last, magic in self.automaton.iter(data.decode("latin-1")):
            marks.places.setdefault(magic, []).append(last + 1 - len(magic))
        for magic, check in SIGNATURES.items():
            hits += [(at, check) for at in marks.places.get(magic, ())]
        found: list[tuple[int, int, str, int]] = []
        around: list[tuple[int, bool]] = []  # end of each medium that holds the place, and whether it is a container
        for at, check in sorted(hits, key=lambda h: h[0]):
            while around and around[-1][0] <= at:
                around.pop()
            if around and not around[-1][1]:
                continue
            got = check(data, at, marks)
            if got and (not around or at + got[0] <= around[-1][0]):
                found.append((at, *got, len(around)))
                around.append((at + got[0], got[1] in CONTAINERS))
        return found


SNIFFED = T.StructType([
    T.StructField("detected_type", T.StringType()), T.StructField("corrected", T.BooleanType()),
    T.StructField("carved", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("depth", T.IntegerType())]))),
])


def sniff(df: DataFrame, data: str = "media", declared: str = "declared_type") -> DataFrame:
    """df with detected_type, corrected (declared otherwise) and carved [(start, length, type, depth)].

    The detected type is that of a confirmed medium at byte 0, else application/octet-stream; all other confirmed media
    are in carved, with the number of confirmed media that hold them. Null bytes: null type, not corrected, nothing carved. A null declared type counts as unknown.
    Other columns stay; columns named like the three new ones are replaced. Repeated rows get equal values.
    """
    df = df.drop(*(c for c in SNIFFED.names if c not in (data, declared)))
    schema, columns = T.StructType([*df.schema, *SNIFFED]), df.columns

    def make() -> Callable:
        sniffer = Sniffer()

        def work(batch):
            kinds, corrected, carved = [], [], []
            for value, said in zip(batch.column(data), batch.column(declared).to_pylist(), strict=True):
                value = value.as_py()
                if value is None:
                    kinds.append(None)
                    corrected.append(False)
                    carved.append([])
                    continue
                found = sniffer.find(value)
                kind = found[0][2] if found and found[0][0] == 0 else UNKNOWN
                kinds.append(kind)
                corrected.append(kind != (said or UNKNOWN))
                carved.append([{"start": a, "length": n, "type": k, "depth": d} for a, n, k, d in found if a])
            yield {c: batch.column(c) for c in columns} | {"detected_type": kinds, "corrected": corrected, "carved": carved}

        return work

    return map_batches(df, make, schema)


def wav(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples at 8 kHz."""
    pad = len(payload) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + bytes(pad)


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """The sample bytes of a WAV file and where they begin, found by its chunks."""
    place, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while place + 8 <= end:
        size = struct.unpack_from("<I", data, place + 4)[0]
        if data[place : place + 4] == b"data":
            return data[place + 8 : place + 8 + size], place + 8
        place += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes with bytes 0 up to a positive multiple of 64, and how many they were before."""
    data = text.encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


#: What the documents' texts are said to be.
DECLARED = "text/plain"
STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("declared_type", T.StringType()), T.StructField("media", T.BinaryType())])
FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def store_media(docs: DataFrame) -> DataFrame:
    """Each text as a WAV medium in a written table (doc_id, n_bytes, declared_type, media). Null text: empty.

    They are declared as what the table holds, DECLARED: sniff() has to find out and correct it.
    """

    def make() -> Callable:
        def work(batch):
            media, sizes = [], []
            for text in texts_of(batch):
                payload, n = payload_of(text)
                media.append(wav(payload))
                sizes.append(n)
            yield {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "declared_type": [DECLARED] * len(sizes), "media": media}

        return work

    return written(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, STORED), "media")


def media_features(docs: DataFrame) -> DataFrame:
    """Store texts as media, read them back, sniff them and compute features; a row for each row of docs.

    feature says the declared and the detected type, whether that was a correction, the number of samples and the media that lie within them, each as
    type@place in the payload+length/depth. Null and empty texts are stored as 64 bytes 0; repeated rows get equal values; an empty table gives no rows.
    """
    sniffed = sniff(store_media(docs))

    def make() -> Callable:
        def work(batch):
            rows: dict[str, list] = {f: [] for f in FEATURES.names}
            for doc, n, media, said, kind, corrected, carved in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "declared_type", "detected_type", "corrected", "carved")), strict=True):
                if kind != "audio/wav":
                    raise ValueError(f"stored medium of {doc} reads as {kind}")
                payload, skip = wav_samples(media)
                rows["doc_id"].append(doc)
                rows["n_bytes"].append(n)
                rows["payload_bytes"].append(len(payload))
                rows["payload_sha256"].append(sha256(payload).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(payload[-64:]))
                rows["media_bytes"].append(len(media))
                rows["media_sha256"].append(sha256(media).hexdigest())
                within = ",".join(f"{c['type']}@{c['start'] - skip}+{c['length']}/{c['depth']}" for c in carved)
                rows["feature"].append(f"{kind};declared={said};corrected={int(corrected)};samples={len(payload)};embedded={within}")
            yield rows

        return work

    return map_batches(sniffed, make, FEATURES)
