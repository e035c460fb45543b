"""Providers that fail: outcomes, order, halving, and what ingestion and search make of them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.encoders import pseudo_vector
from corvane.plans import ingest
from corvane.sources import providers
from corvane.sources.index import PointIndex
from corvane.sources.providers import Caller, Provider, ProviderError

CONFIG = {"version": 1, "dense_dimension": 4, "chunk_size_tokens": 40, "chunk_overlap_tokens": 8}


def made():
    """A provider, made here so that workers get it whole."""

    def flaky(path, body):
        """Fails for texts with BAD in them, and replies in another order."""
        if any("BAD" in t for t in body["input"]):
            raise ProviderError("HTTP_400")
        data = [{"index": i, "embedding": pseudo_vector(t, body["dimensions"])} for i, t in enumerate(body["input"])]
        return {"data": data[::-1]}

    return flaky


def test_a_bad_text_stands_alone():
    calls = Counter()

    def send(texts):
        calls[len(texts)] += 1
        if "bad" in texts:
            raise ProviderError("HTTP_400")
        return [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(15)] + ["bad"]
    found = Caller(send).outcomes(texts)
    assert [v for v, _, _ in found] == [t.upper() for t in texts[:-1]] + [None] and [e for _, e, _ in found] == [None] * 15 + ["HTTP_400"]
    assert calls == {16: 1, 8: 2, 4: 2, 2: 2, 1: 2} and found[-1][2] == 5 and found[0][2] == 2


def test_passing_errors_are_tried_again_and_outages_end():
    waited, left = [], [2]

    def send(texts):
        if left[0]:
            left[0] -= 1
            raise ProviderError("TIMEOUT", True)
        return texts

    assert Caller(send, 3, lambda n: n + 1.0, waited.append).outcomes(["a", "b"]) == [("a", None, 3), ("b", None, 3)] and waited == [1.0, 2.0]
    calls = []

    def dead(texts):
        calls.append(len(texts))
        raise ProviderError("TIMEOUT", True)

    found = Caller(dead, 2, lambda n: 0.0).outcomes([str(i) for i in range(64)])
    assert [e for _, e, _ in found[:3]] == ["TIMEOUT"] * 3 and {e for _, e, _ in found[3:]} == {"UNAVAILABLE"} and len(calls) < 30


@pytest.mark.parametrize(("reply", "code"), [
    ({"data": []}, "COUNT_MISMATCH"), ({}, "COUNT_MISMATCH"), ({"data": [{"index": 1, "embedding": [1, 0]}]}, "BAD_INDEX"), ({"data": [{"index": 0, "embedding": [1]}]}, "INVALID_DIMENSION"),
    ({"data": [{"index": 0, "embedding": [1, float("nan")]}]}, "NOT_FINITE"), ({"data": [{"index": 0}]}, "INVALID_DIMENSION"), ({"data": [{"index": "0", "embedding": [1, 0]}]}, "BAD_INDEX"),
])
def test_replies_are_checked(reply, code):
    assert Caller(providers.dense_vectors(lambda p, b: reply, "m", 2)).outcomes(["x"]) == [(None, code, 1)]
    assert providers.dense_vectors(lambda p, b: {"data": [{"embedding": [3, 4]}]}, "m", 2)(["x"]) == [[0.6, 0.8]]
    with pytest.raises(ProviderError):
        providers.sparse_vectors(lambda p, b: {"vectors": [{"indices": [1], "values": []}]}, "m")(["x"])
    with pytest.raises(ProviderError):
        providers.variants(lambda p, b: {"choices": []}, "m", 3)(["x"])


def test_every_row_has_an_outcome_and_each_text_is_sent_once(spark):
    seen, flaky = spark.sparkContext.accumulator(0), made()

    def post(path, body):
        seen.add(len(body["input"]))
        return flaky(path, body)

    rows = spark.createDataFrame([(i, ["one", "two", "BAD text", None][i % 4]) for i in range(40)], "n int, said string")
    provider = Provider(providers.dense_vectors(post, "m", 4), T.ArrayType(T.DoubleType()), batch=8)
    found = providers.with_values(rows, "said", provider, "v").collect()
    assert len(found) == 40
    for r in found:
        want = {"one": None, "two": None, "BAD text": "HTTP_400", None: "EMPTY"}[r["said"]]
        assert r["v_error"] == want and (r["v"] is None) == (want is not None)
        if r["v"]:
            assert r["v"] == pytest.approx(pseudo_vector(r["said"], 4))
    assert seen.value <= 3 * 3  # three texts, sent again only where a batch is halved


def _documents(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.md", "text/markdown", 1, t) for i, t in rows], "document_id string, filename string, content_type string, document_version int, markdown string")


def test_ingestion_fails_by_document_and_skips_what_it_has(spark, tmp_path):
    index, flaky = PointIndex(spark, f"file://{tmp_path}/i", buckets=2), made()
    provider = Provider(providers.dense_vectors(flaky, "m", 4), T.ArrayType(T.DoubleType()), batch=4)
    docs = _documents(spark, ("a", "# A\n" + "word " * 60), ("b", "fine words\n" + "x " * 50 + "BAD end"), ("c", " "), ("d", "other"), ("e", None))
    told = {r["document_id"]: r for r in ingest.ingest(index, docs, CONFIG, dense=provider).collect()}
    assert {k: (r["status"], r["error"]) for k, r in told.items()} == {"a": ("READY", None), "b": ("FAILED", "HTTP_400"), "c": ("FAILED", "EMPTY_MARKDOWN"), "d": ("READY", None), "e": ("FAILED", "EMPTY_MARKDOWN")}
    assert {r["document_id"] for r in index.points().collect()} == {"a", "d"} and told["a"]["chunk_count"] == 2
    parts = index.state()["parts"]
    known = spark.createDataFrame([(r["document_id"], r["checksum"], r["status"], r["chunk_count"]) for r in told.values()], "document_id string, checksum string, status string, chunk_count long")
    calls = spark.sparkContext.accumulator(0)

    def counting(path, body):
        calls.add(1)
        return flaky(path, body)

    again = docs.where("document_id in ('a', 'd')").withColumn("markdown", F.when(F.col("document_id") == "d", "changed").otherwise(F.col("markdown")))
    told = {r["document_id"]: r for r in ingest.ingest(index, again, CONFIG, known, Provider(providers.dense_vectors(counting, "m", 4), T.ArrayType(T.DoubleType()))).collect()}
    assert told["a"]["status"] == "DUPLICATE" and told["a"]["chunk_count"] == 2 and told["d"]["status"] == "READY" and calls.value == 1
    assert {r["text"] for r in index.points().where("document_id = 'd'").collect()} == {"changed"} and sum(parts[k] != g for k, g in index.state()["parts"].items()) == 1


def test_reranker_and_expander(spark):
    def post(path, body):
        if path == "/rerank":
            if body["query"] == "down":
                raise ProviderError("HTTP_400")
            if body["query"] == "odd":
                return {"results": [{"index": 99, "score": 1.0}]}
            return {"results": [{"index": i, "relevance_score": len(t)} for i, t in enumerate(body["documents"]) if t]}
        return {"choices": [{"message": {"content": "1. first way\n- second way\n" + body["messages"][1]["content"]}}]}

    candidates = spark.createDataFrame([("q", "1", "up", "aa"), ("q", "2", "up", "a"), ("q", "3", "up", ""), ("r", "1", "down", "aa"), ("s", "1", "odd", "aa")], "query_id string, id string, query string, text string")
    got = {(r["query_id"], r["id"]): (r["score"], r["error"]) for r in providers.reranker(post, "m")(candidates).collect()}
    assert got == {("q", "1"): (2.0, None), ("q", "2"): (1.0, None), ("q", "3"): (None, None), ("r", "1"): (None, "HTTP_400"), ("s", "1"): (None, "BAD_INDEX")}

    def encode(rows):
        return rows.withColumn("dense", F.array(F.length("text").cast("double"))).withColumn("sparse", F.lit(None).cast("array<struct<idx:bigint,weight:double>>"))

    expand = providers.expander(Provider(providers.variants(post, "m", 2), T.StringType()), 2, encode)
    rows = expand(spark.createDataFrame([("q", "the query")], "query_id string, text string")).collect()
    assert sorted((r["variant_id"], r["dense"]) for r in rows) == [("q/0", [9.0]), ("q/1", [10.0])]

    def broken(path, body):
        raise ProviderError("HTTP_400")

    none = providers.expander(Provider(providers.variants(broken, "m", 2), T.StringType()), 2, encode)
    assert none(spark.createDataFrame([("q", "the query")], "query_id string, text string")).count() == 0
