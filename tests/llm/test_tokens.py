"""Packing, token files, token counts and pre-token encoding."""

import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import packing, pretoken, queries, simple8b, token_counts
from corvane.llm.pretoken import ChunkEncoder

BYTE, WORD, PIECE = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "　", " ", "a", "The", "wörd", "É", "Σ", "İ", "ß", "’s", "'s", "12", "...", "!?", "###", "▁", "́", "😀", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "\x00", "x|y", "𝔘"]


def odd_texts(n=1500, seed=5):
    rng = random.Random(seed)
    return ["", " ", "a", *("".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n))]


@pytest.mark.parametrize(("path", "keeps"), [(BYTE, True), (WORD, False)])
def test_chunks_encode_like_whole_texts(path, keeps):
    texts = odd_texts()
    encoder = ChunkEncoder(path, keeps, most=50)  # a small bound, so that it is passed
    want = [array("I", e.ids).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [x for at in range(0, len(texts), 100) for x in encoder.encode(texts[at : at + 100])]
    assert got == want
    assert len(encoder.known) <= 150


def test_counts_are_those_of_whole_texts():
    texts = odd_texts()
    counter = token_counts.PieceCounter(PIECE)
    want = [len(x) for x in counter.model.encode(texts, num_threads=1)]
    assert [x for at in range(0, len(texts), 100) for x in counter.counts(texts[at : at + 100])] == want
    assert not counter.whole


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, extra string")


ROWS = [(3, "alpha beta " * 900, "x", "y"), (1, None, "x", "y"), (2, "", None, None), (None, "no id", "x", "y"), (2, "twin", "x", "y"), (2, "twin", "x", "y"), (7, "gamma\tdelta <|endoftext|>", "x", "y"), (9, "a" * 30_000, "x", "y")]


def test_count_query_rows(spark):
    rows = token_counts.count_tokens(_docs(spark, ROWS), PIECE, 100).collect()
    model = token_counts.PieceCounter(PIECE).model
    want = sorted((d is None, d or 0, len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert token_counts.count_tokens(_docs(spark, []), PIECE, 1).count() == 0


def test_counts_over_many_slices(spark):
    """Pre-tokens that occur over 255 times in a text, in all slices or in one, and texts that are counted whole."""
    texts = [*odd_texts(300, 9), "the " * 700, "the " * 256 + "end", "a▁b " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    model = token_counts.PieceCounter(PIECE).model
    want = [(i, len(t.encode()), len(model.encode(t))) for i, t in enumerate(texts)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PIECE, 100).collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=600))
def test_blocks_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, places, escaped = simple8b.encode_block(v)
    out = simple8b.decode_words(words, len(v))
    out[places] = escaped
    assert (out == v).all()


def test_blocks_are_word_aligned_and_small():
    words, places, _ = simple8b.encode_block(np.zeros(240, dtype=np.uint64))
    assert len(words) == 1 and not len(places)
    words, places, escaped = simple8b.encode_block(np.array([1] * 239 + [2**40], dtype=np.uint64))
    assert len(words) <= 5 and escaped.tolist() == [2**40]


def test_files_round_trip_and_reject_damage():
    rng = random.Random(2)
    ids = [np.array([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 5, 9000]))]) for _ in range(7)]
    data = simple8b.encode_file([None, 1, 2, 2, 3, 4, 5], ids)
    docs, lengths, values = simple8b.decode_file(data)
    assert docs == [None, 1, 2, 2, 3, 4, 5] and lengths.tolist() == [len(x) for x in ids]
    assert (values == np.concatenate(ids).astype(np.uint64)).all()
    with pytest.raises(ValueError):
        simple8b.decode_file(data + b"x")
    with pytest.raises(ValueError):
        simple8b.decode_file(b"junk" * 20)
    assert simple8b.decode_file(simple8b.encode_file([], []))[0] == []


def test_token_files(spark, tmp_path):
    docs = _docs(spark, ROWS)
    folder = f"file://{tmp_path}/files"
    manifest = simple8b.write_token_files(docs, WORD, 2, folder, run_rows=2, file_ids=500)
    rows = simple8b.read_token_files(manifest).orderBy("start").collect()
    tokenizer = ChunkEncoder(WORD, False).tokenizer
    ids = {(d is None, d, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in ROWS}
    order = sorted((d is not None, d or 0, t or "") for d, t, *_ in ROWS)
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows] == [o[:2] for o in order]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((len(v), zlib.crc32(array("I", v).tobytes())) for k, v in ids.items() for _ in range(sum(1 for d, t, *_ in ROWS if (d is None, d, t) == k)))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert simple8b.token_files(docs.where("false"), WORD).count() == 0


# --- packing ---


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=25))
def test_plans_hold_every_document_once(lengths):
    plan = packing.plan_packing(lengths, 64)
    seen = Counter()
    for members, times in plan:
        assert sum(members) <= 64 and times > 0
        for k in members:
            seen[k] += times
    assert seen == Counter(lengths)


def test_plans_come_near_the_bound():
    rng = random.Random(1)
    lengths = Counter(rng.randint(1, 1023) for _ in range(20_000))
    sequences = sum(n for _, n in packing.plan_packing(lengths, 1024))
    assert sequences <= 1.01 * sum(k * n for k, n in lengths.items()) / 1024 + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_configurations_fill_the_sequences(seed):
    """Most sequences come from configurations of groups, and they are as few as best fit alone would need, but for a thousandth."""
    rng = random.Random(seed)
    lengths = Counter(max(1, min(1023, int(rng.lognormvariate(5.6, 0.9)))) for _ in range(15_000))
    grouped, _ = packing._grouped(lengths, 1024, packing.GROUPS)
    total = sum(n for _, n in packing.plan_packing(lengths, 1024))
    assert sum(n for _, n in grouped) >= 0.9 * total
    assert total <= 1.001 * sum(n for _, n in packing._best_fit([], lengths, 1024)) + 1


def test_clashing_names_of_pieces(spark):
    rows = spark.createDataFrame([(1, 0, 5, "a", 7, "b"), (1, 0, 5, "a", 7, "b"), (2, 0, 3, None, 8, None)], "doc_id long, piece int, length long, _rank string, sequence_id long, _block string")
    got = packing.pack(rows, 8)
    assert got.columns == ["doc_id", "piece", "length", "_rank", "_block", "sequence_id", "offset"]
    assert sorted((r["doc_id"], r["_rank"] or "", r["offset"]) for r in got.collect()) in ([(1, "a", 0), (1, "a", 0), (2, "", 5)], [(1, "a", 0), (1, "a", 3), (2, "", 0)])
    assert {r["sequence_id"] for r in got.collect()} == {0, 1}


def test_exact_halves():
    assert sum(n for _, n in packing.plan_packing({512: 1000}, 1024)) == 500
    assert sum(n for _, n in packing.plan_packing({700: 100, 324: 100}, 1024)) == 100
    assert packing.plan_packing({}, 8) == []
    with pytest.raises(ValueError):
        packing.plan_packing({9: 1}, 8)


def test_packed_pieces(spark):
    docs = _docs(spark, ROWS)
    rows = packing.pack_documents(docs, BYTE, 64, 2).collect()
    tokenizer = ChunkEncoder(BYTE, True).tokenizer
    want = []
    for d, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids), 64), len(ids)]
        want += [(d is None, d or 0, i, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs.where("false"), BYTE).count() == 0


def test_words_of_a_block_by_the_format_s_table():
    """Every selector, with escapes and a last word that isn't full: words are read value by value, without the decoder."""
    rng = np.random.default_rng(7)
    runs = [rng.integers(0, 1 << width, 2 * count + 1, dtype=np.uint64) for count, width in simple8b.SELECTORS] + [np.array([2**63 + 5, 2**61], dtype=np.uint64)]
    for values in (np.concatenate(runs), np.concatenate(runs[::-1]), *runs):
        words, places, escaped = simple8b.encode_block(values)
        plain = []
        for word in words.tolist():
            count, width = simple8b.SELECTORS[word >> 60]
            plain += [word >> (j * width) & ((1 << width) - 1) for j in range(count)]
        assert simple8b.decode_words(words, len(values)).tolist() == plain[: len(values)]
        for at, value in zip(places.tolist(), escaped.tolist(), strict=True):
            plain[at] = value
        assert plain[: len(values)] == values.tolist() and not any(plain[len(values) :])


def test_forms_of_a_word_are_tokenized_once():
    """Capitals and marks make no new piece, in one batch or in the next."""
    forms = ["Rewhble", "rewhble,", "REWHBLE.", "rewhble", "Élan", "élan!", "ÉLAN?!"]
    encoder, asked = ChunkEncoder(WORD, False), []

    class Counting:
        def __init__(self, model):
            self.tokenize = lambda piece: asked.append(piece) or model.tokenize(piece)

    encoder.model = Counting(encoder.model)
    texts = [" ".join(forms), "\n".join(reversed(forms)), *forms]
    want = [array("I", e.ids).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) + encoder.encode(texts) == want * 2
    assert sorted(asked) == ["rewhble", "".join(map(encoder.letters.__getitem__, "élan".encode()))]


@pytest.mark.parametrize(("path", "keeps"), [(BYTE, True), (WORD, False)])
def test_columns_of_ids(path, keeps):
    """Nulls, parts of a longer column, texts with other white space between others, and nothing at all."""
    encoder = ChunkEncoder(path, keeps, most=50)
    texts = [None, " word.", "  word", " ...", "a\n b, c\n\n", *odd_texts(400, 11), None, "x\ty", "", "x\u00a0y z", "Ünï |x| a|b"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for at, n in ((0, len(texts)), (7, 90), (len(texts) - 6, 6), (3, 0), (0, 1)):
            ids, counts = encoder.columns(column.slice(at, n))
            assert counts.tolist() == [len(x) for x in want[at : at + n]]
            assert ids.tolist() == [i for x in want[at : at + n] for i in x]
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    other = pc.match_substring_regex(pa.array(every), pretoken._OTHER_SPACE).to_pylist()
    assert other == [c.isspace() and c not in " \n" for c in every]
