"""Scalar functions against Python's own."""

import hashlib
import re
import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import encoders, identity, stem, vectors
from corvane.functions import text as X


def _one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


TEXTS = ["", " ", "a\x00b", "é", "é x  y　z", " a\x1cb ", "Größe_1 ÄÖ", "Привет, МИР!", "token=abc&x Token=q z", "a|b | **c** `d`"]


def test_normalize(spark):
    want = [re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", unicodedata.normalize("NFC", t))).strip() for t in TEXTS]
    assert _one(spark, TEXTS, X.normalize_query) == want


def test_terms(spark):
    texts = ["The cat and THE dog_1 a b Größe", "и кот на крыше", "x yy"]
    assert _one(spark, texts, X.terms) == [["cat", "dog_1", "grösse"], ["кот", "крыше"], ["yy"]]


def test_separators_and_rows(spark):
    pattern = re.compile(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")
    lines = ["---", "|---|", "| :-: | - |", "", "|", "a | b", "||--", "- a", " -", ":", "|:|", "--|--"]
    assert _one(spark, lines, X.is_separator) == [bool(pattern.match(x)) for x in lines]
    assert _one(spark, ["| a | **b** |", "a|b", "||", " | x"], X.split_row) == [["a", "b"], ["a", "b"], [""], ["x"]]


def test_masks_and_headers(spark):
    assert _one(spark, ["go?token=abc&x=1"], X.redact) == ["go?token=***&x=1"]
    ok = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    assert _one(spark, [ok, "junk", None], X.trace_id) == ["a" * 32, None, None]


def test_listed_lines(spark):
    got = _one(spark, ["1. alpha\n- beta\n* alpha\nQ\nThe Query\n\ngamma"], lambda c: X.listed_lines(c, F.lit("the query "), 2))
    assert got == [["alpha", "beta"]]


def test_point_ids(spark):
    namespace = uuid.UUID(identity.POINT_NAMESPACE)
    names = ["d:1:1:0", "документ:2:3:1000000", "x" * 50]
    assert _one(spark, names, identity.uuid5) == [str(uuid.uuid5(namespace, n)) for n in names]


def test_filenames(spark):
    names = ["a b.txt", "/x/../y/p?.md", "..\\..\\secret", "___", "é.pdf", "n" * 300, ""]
    assert _one(spark, names, identity.sanitize_filename) == ["a_b.txt", "p_.md", "secret", "file", "pdf", "n" * 200, "file"]


def test_domains():
    assert identity.scoped_to_domain("hr-docs", "hr") and identity.scoped_to_domain("docs_hr_1", "hr")
    assert not identity.scoped_to_domain("three", "hr") and not identity.scoped_to_domain("x", "")


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<double>")
    got = rows.select(vectors.l2_normalize(F.col("v")).alias("u"), vectors.is_valid(F.col("v"), 2).alias("ok")).collect()
    assert got[0]["u"] == [0.6, 0.8] and got[1]["u"] == [0.0, 0.0]
    assert [r["ok"] for r in got] == [True, True, False]


def test_hashed_terms(spark):
    want = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") % (1 << 20) for t in ("cat", "кот")]
    assert _one(spark, ["cat", "кот"], encoders.term_index) == want


def test_pseudo_vectors():
    v = encoders.pseudo_vector("text", 16)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == encoders.pseudo_vector("text", 16) != encoders.pseudo_vector("other", 16)


def test_stems():
    english = {"running": "run", "caresses": "caress", "ponies": "poni", "relational": "relat", "consignment": "consign", "knightly": "knight", "generously": "generous", "happy": "happi", "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "skies": "sky"}
    russian = {"вавиловка": "вавиловк", "важная": "важн", "валяются": "валя", "противоположность": "противоположн", "падавшую": "пада", "положила": "полож", "покупатель": "покупател", "расходов": "расход", "длинный": "длин"}
    assert {w: stem.stem_english(w) for w in english} == english
    assert {w: stem.stem_russian(w) for w in russian} == russian


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=12))
def test_stemming_never_fails(word):
    assert isinstance(encoders.stem_word(word.casefold()), str)


def test_only_texts_that_composition_may_change_leave_the_jvm(spark):
    texts = [None, "", "plain", "café ˿", "café", "á̧ 가 Å", "\U0001f600 " * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    composed = rows.select("i", X.nfc(F.col("t")).alias("t"))
    assert dict(map(tuple, composed.collect())) == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    assert "RLIKE" in composed._jdf.queryExecution().executedPlan().toString()
