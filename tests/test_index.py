"""The stored index: writes by bucket, postings, membership, and searches with filters and fallbacks."""

import random
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import dense, membership
from corvane.operators.postings import Bucket
from corvane.plans.index_search import Options, _lists, search_index, word_overlap
from corvane.schemas import POINT
from corvane.sources import index as index_module
from corvane.sources.index import PointIndex


def _points(spark, rows, version=1):
    """rows: (document_id, chunk_index, text, dense, sparse[, document_version][, day])"""
    full = []
    for document, chunk, text, vector, sparse, *more in rows:
        document_version, day = (*more, *(1, 1)[len(more) :])
        given = {"id": f"{document}:{chunk}", "document_id": document, "document_version": document_version, "index_version": version, "chunk_index": chunk, "filename": f"{document}.md", "text": text, "created_at": datetime(2024, 1, 1 + day), "dense": vector, "sparse": sparse}
        full.append([given.get(f.name) for f in POINT])
    return spark.createDataFrame(full, POINT)


def _files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    index = PointIndex(spark, f"file://{tmp_path}/i", buckets=6, shards=2)
    index.ensure(1, 2)
    rows = [(f"d{i}", 0, "t", [1.0, 0.0], [(i % 5, 1.0)]) for i in range(60)]
    index.upsert(_points(spark, rows))
    index.upsert(_points(spark, rows, 2))
    before, parts = _files(tmp_path / "i"), index.state()["parts"]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    index.upsert(_points(spark, [("d7", 0, "new", [0.0, 1.0], [(99, 2.0)])]).withColumn("text", counted("text")))
    assert calls.value == 1  # what is new is computed once
    now = index.state()["parts"]
    changed = {k for k in parts if parts[k] != now[k]}
    assert len(parts) == 12 and len(changed) == 1 and changed.pop().startswith("1/")
    after = _files(tmp_path / "i")
    own = {p for p in before if p in after and before[p] == after[p]}
    assert len(own) == len(before) - sum(1 for p in before if p not in after)  # what stays is untouched
    assert {r["text"] for r in index.points().where("document_id = 'd7'").collect()} == {"t", "new"} and index.points().count() == 120
    index.delete_documents(spark.createDataFrame([("d7",), ("unknown",)], "document_id string"))
    assert index.points().where("document_id = 'd7'").isEmpty() and index.points().count() == 118
    gone = _files(tmp_path / "i")
    index.delete_documents(spark.createDataFrame([("unknown",)], "document_id string"))
    assert _files(tmp_path / "i") == gone  # nothing to do, nothing written
    # files that neither the pointer nor the one before it names are gone, and so is the staged copy
    live = {(g, *k.split("/")) for k, g in (*index.state()["parts"].items(), *index.state()["before"].items())}
    found = {tuple(x.partition("=")[2] for x in p.relative_to(tmp_path / "i/points").parts[:3]) for p in gone if "points" in p.relative_to(tmp_path / "i").parts}
    assert found <= live and not [*(tmp_path / "i").glob("staged/*")]


def test_a_reader_keeps_its_state_over_a_write(spark, tmp_path):
    index = PointIndex(spark, f"file://{tmp_path}/i", buckets=1)
    index.ensure(1, 1)
    index.upsert(_points(spark, [("a", 0, "old", [1.0], [])]))
    seen = index.points()
    index.upsert(_points(spark, [("a", 0, "new", [1.0], [])]))
    assert [r["text"] for r in seen.collect()] == ["old"] and [r["text"] for r in index.points().collect()] == ["new"]


def test_a_large_document_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "SPREAD", 4)
    index = PointIndex(spark, f"file://{tmp_path}/i", buckets=8)
    index.ensure(1, 1)
    index.upsert(_points(spark, [("big", i, "t", [1.0], []) for i in range(64)]))
    assert index.placed(1).select("bucket").distinct().count() > 3
    index.delete_documents(spark.createDataFrame([("big",)], "document_id string"), 1)
    assert index.points().count() == 0 and index.state()["parts"] == {}


def test_description_and_drift(spark, tmp_path):
    index = PointIndex(spark, f"file://{tmp_path}/i")
    expected = {"dimension": 4, "distance": "cosine", "weighting": "idf", "vocabulary": 1 << 20}
    assert {r["property"] for r in index.drift(**expected).collect()} == set(expected)
    index.ensure(1, 4, weighting="idf")
    assert index.drift(**expected).isEmpty()
    for name, value in (("dimension", 5), ("distance", "dot"), ("weighting", "none"), ("vocabulary", 7)):
        assert [tuple(r)[0] for r in index.drift(**expected | {name: value}).collect()] == [name]
    for bad in ({"distance": "dot"}, {"vocabulary": 7}):
        with pytest.raises(ValueError, match="other properties"):
            index.ensure(1, 4, **bad)
    with pytest.raises(ValueError, match="dimensions"):
        index.ensure(1, 5)
    assert index.ensure(1, 4, weighting="none")["weighting"] == "none"  # reconciled
    with pytest.raises(ValueError, match="properties"):
        PointIndex(spark, f"file://{tmp_path}/j").ensure(1, 4, colour=1)


weights = st.floats(0.01, 3.0).map(lambda x: round(x, 3))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), weights, max_size=8), min_size=1, max_size=60), st.dictionaries(st.integers(0, 14), weights, max_size=6), st.integers(1, 7), st.integers(1, 5), st.integers(0, 3))
def test_buckets_find_what_all_products_find(docs, query, k, size, odd):
    live = [i for i in range(len(docs)) if i % 4 != odd]
    lists: dict[int, list] = {}
    for i, d in enumerate(docs):
        for t, w in d.items():
            lists.setdefault(t, []).append((i, w))
    blocks = [{"idx": t, "block": n, "best": max(w for _, w in x[n * size : n * size + size]), "ords": [i for i, _ in x[n * size : n * size + size]], "weights": [w for _, w in x[n * size : n * size + size]]} for t, x in lists.items() for n in range(-(-len(x) // size))]
    bucket = Bucket([{"ord": i, "id": f"{i:03}", "about": None} for i in live], blocks)
    scores = {i: sum(w * docs[i].get(t, 0) for t, w in query.items()) for i in live}
    want = sorted(((round(s, 9), -i) for i, s in scores.items() if s > 0), reverse=True)[:k]
    assert [(round(s, 6), i) for i, s in bucket.best([*query.items()], k)] == [(round(s, 6), -i) for s, i in want]


def test_maxima_spare_blocks():
    rng = random.Random(1)
    n = 20_000
    rare, common = sorted(rng.sample(range(n), 40)), range(n)
    block = lambda t, x, w: [{"idx": t, "block": b, "best": w, "ords": [*x[b * 128 : b * 128 + 128]], "weights": [w] * len(x[b * 128 : b * 128 + 128])} for b in range(-(-len(x) // 128))]
    bucket = Bucket([{"ord": i, "id": i, "about": None} for i in common], block(1, rare, 2.0) + block(2, common, 0.1))
    assert [i for i, _ in bucket.best([(1, 1.0), (2, 1.0)], 10)] == rare[:10]
    assert bucket.looked <= 42 < len(bucket.terms[2])  # the rare term's blocks, and those of the common one that hold its points


def test_cells_are_skipped_and_nothing_is_missed(spark):
    rng = np.random.default_rng(3)
    around = rng.normal(size=(12, 16))
    points = [(f"p{i:04}", (around[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(3000)]
    points += [("zero", [0.0] * 16), ("same", points[0][1]), ("none", None)]
    table = spark.createDataFrame(points, "id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", (around[i] + 0.05 * rng.normal(size=16)).tolist()) for i in range(12)] + [("z", [0.0] * 16)], "query_id string, embedding array<double>")
    got = {}
    found = dense.dense_top(table, queries, 7, id="id")
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    names = [p for p, v in points if v is not None]
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
    matrix = unit(np.array([v for _, v in points if v is not None]))
    for q in queries.collect():
        s = np.round(matrix @ unit(np.array([q["embedding"]]))[0], 9)
        best = sorted(range(len(names)), key=lambda i: (-s[i], names[i]))[:7]
        assert [x[1] for x in sorted(got[q["query_id"]])] == [names[i] for i in best]
    sample, _ = dense.sampled(table, "embedding", [F.lit(None).cast("struct<a:int>").alias("about")])
    blocks = dense.cells(table.where("embedding is not null"), "id", "embedding", dense.centres(sample), F.lit(None).cast(dense.ABOUT)).collect()
    q = queries.collect()[0]["embedding"]
    least = np.sort(matrix @ unit(np.array([q]))[0])[-7]
    bound = [np.cos(max(0.0, np.arccos(np.clip(unit(np.array([q]))[0] @ np.frombuffer(b["centre"]), -1, 1)) - b["radius"])) if b["radius"] < np.pi else 2 for b in blocks]
    assert sum(x >= least for x in bound) * 4 < len(blocks)  # most cells are skipped
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan


def test_membership(spark):
    rows = spark.createDataFrame([(i, f"k{i % 700}" if i % 50 else None) for i in range(2000)], "n long, key string")
    members = spark.createDataFrame([(f"k{i}",) for i in range(0, 700, 3)] * 2 + [(None,)], "key string")
    inside, outside = membership.split(rows, members, "key")
    there = {f"k{i}" for i in range(0, 700, 3)}
    want = sorted(r["n"] for r in rows.collect() if r["key"] in there)
    assert sorted(r["n"] for r in inside.collect()) == want
    assert sorted(r["n"] for r in outside.collect()) == sorted(set(range(2000)) - set(want))
    words, bits = membership.bloom(members, "key")
    passed = rows.where("key is not null").join(words, membership.maybe(F.col("key"), F.col("_words"), bits), "left_semi")
    held = {r["key"] for r in passed.collect()}
    assert there & {r["key"] for r in rows.collect()} <= held and len(held - there) < 30  # no member is lost, few others pass
    none = members.where("false")
    assert membership.known_members(rows, none, "key").isEmpty() and membership.missing_members(rows, none, "key").count() == 2000
    assert membership.bloom(spark.range(6_000_000).select(F.col("id").cast("string").alias("key")), "key") is None


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    index = PointIndex(spark, f"file://{tmp_path_factory.mktemp('small')}/i", buckets=2, shards=2)
    index.ensure(1, 2)
    rows = [("a", 0, "red apple", [1.0, 0.0], [(1, 1.0)], 1, 1), ("b", 0, "green apple", [0.9, 0.1], [(1, 0.8), (2, 1.0)], 2, 5), ("c", 0, "blue sky", [0.0, 1.0], [(3, 1.0)], 1, 9), ("d", 0, "red sky", [0.6, 0.6], [(1, 0.5), (3, 0.5)], 1, 9)]
    index.upsert(_points(spark, rows))
    index.upsert(_points(spark, [("a", 0, "other version", [1.0, 0.0], [(1, 9.0)])], 7))
    return index


REQUEST = "query_id string, text string, dense array<double>, sparse array<struct<idx:bigint,weight:double>>, document_ids array<string>, document_version int, created_from timestamp, created_to timestamp, limit int, max_candidates int"


def _asked(spark, *rows):
    names = [x.split()[0] for x in REQUEST.split(", ")]
    plain = {"text": "red", "dense": [1.0, 0.0], "sparse": [(1, 1.0)], "limit": 10, "max_candidates": 10}
    return spark.createDataFrame([[(plain | r).get(n) for n in names] for r in rows], REQUEST)


def _found(results):
    out = {}
    for r in sorted(results.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["document_id"])
    return out


def test_each_request_has_its_own_filters(spark, small):
    day = lambda n: datetime(2024, 1, 1 + n)
    asked = _asked(spark, {"query_id": "all"}, {"query_id": "ids", "document_ids": ["b", "d"]}, {"query_id": "none", "document_ids": []}, {"query_id": "version", "document_version": 2}, {"query_id": "from", "created_from": day(9)}, {"query_id": "to", "created_to": day(5)}, {"query_id": "span", "created_from": day(5), "created_to": day(5)}, {"query_id": "one", "limit": 1, "max_candidates": 1})
    results, meta = search_index(small, asked)
    got = _found(results)
    assert got["all"] == ["a", "b", "d", "c"] == got["none"] and got["ids"] == ["b", "d"] and got["version"] == ["b"] == got["span"] and got["to"] == ["a", "b"] and got["one"] == ["a"]
    assert set(got["from"]) == {"c", "d"}
    assert {r["index_version"] for r in results.collect()} == {1}
    plan = results._jdf.queryExecution().toString()
    assert "index_version=7" not in plan
    excluded = spark.createDataFrame([("a",)], "document_id string")
    assert _found(search_index(small, asked.where("query_id = 'all'"), excluded=excluded)[0])["all"] == ["b", "d", "c"]


def test_requests_that_fail_stand_alone(spark, small):
    known = spark.createDataFrame([(x,) for x in "abcd"], "document_id string")
    asked = _asked(spark, {"query_id": "good"}, {"query_id": "unknown", "document_ids": ["a", "nobody"]}, {"query_id": "empty", "text": "  "}, {"query_id": "limit", "limit": 99}, {"query_id": "blind", "dense": None, "sparse": None}, {"query_id": "dense", "sparse": []}, {"query_id": "sparse", "dense": None})
    results, meta = search_index(small, asked, known)
    status = {r["query_id"]: (r["status"], r["n_results"]) for r in meta.collect()}
    assert status == {"good": ("OK", 4), "unknown": ("UNKNOWN_DOCUMENT", 0), "empty": ("EMPTY_QUERY", 0), "limit": ("BAD_LIMIT", 0), "blind": ("EMBEDDING_UNAVAILABLE", 0), "dense": ("SPARSE_UNAVAILABLE", 0), "sparse": ("OK", 3)}
    assert set(_found(results)) == {"good", "sparse"}
    _, meta = search_index(small, asked.where("query_id in ('dense', 'sparse')"), options=Options(sparse_only=False, dense_only=True))
    assert {r["query_id"]: r["status"] for r in meta.collect()} == {"dense": "OK", "sparse": "DENSE_UNAVAILABLE"}


def test_a_failed_reranker_leaves_the_fused_order(spark, small):
    def rerank(candidates):
        told = word_overlap(candidates).withColumn("error", F.when((F.col("query_id") == "bad") & (F.col("id") == "a:0"), "TIMEOUT"))
        return told.unionByName(told.withColumn("id", F.lit("stranger")))

    asked = _asked(spark, {"query_id": "good", "text": "sky red"}, {"query_id": "bad", "text": "sky red"})
    results, meta = search_index(small, asked, options=Options(rerank=rerank))
    got = _found(results)
    assert got["good"][0] == "d" and got["bad"] == ["a", "b", "d", "c"]
    told = {r["query_id"]: r for r in meta.collect()}
    assert told["good"]["reranked"] and told["good"]["top_rerank_score"] == 1.0 and not told["good"]["low_confidence"]
    assert not told["bad"]["reranked"] and told["bad"]["top_rerank_score"] is None and not told["bad"]["low_confidence"]


def test_expansion_joins_the_fusion_where_it_is_called_for(spark, small):
    def expand(wanted):
        variants = wanted.select("query_id", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("v"))
        full = variants.select("query_id", F.concat("query_id", "v").alias("variant_id"), F.when(F.col("v") == "v1", F.array(F.lit(0.0), F.lit(1.0))).alias("dense"), F.expr("cast(null as array<struct<idx:bigint,weight:double>>)").alias("sparse"))
        return full  # the second variant's encoders failed

    asked = _asked(spark, {"query_id": "weak", "text": "nothing of the kind"}, {"query_id": "good", "text": "red apple"})
    results, meta = search_index(small, asked, options=Options(rerank=word_overlap, expand=expand))
    told = {r["query_id"]: r["expanded"] for r in meta.collect()}
    assert told == {"weak": True, "good": False} and _found(results)["good"][0] == "a"
    _, meta = search_index(small, asked, options=Options(expand=expand))  # without a reranker only empty results call for it
    assert not any(r["expanded"] for r in meta.collect())


def test_idf_weighting(spark, tmp_path):
    index = PointIndex(spark, f"file://{tmp_path}/i", buckets=2)
    index.ensure(1, 1, weighting="idf")
    index.upsert(_points(spark, [(f"d{i}", 0, "t", [1.0], [(1, 1.0)] + ([(2, 0.5)] if i == 3 else [])) for i in range(9)]))
    asked = _asked(spark, {"query_id": "q", "dense": None, "sparse": [(1, 1.0), (2, 1.0)]})
    results, meta = search_index(index, asked)
    assert _found(results)["q"][0] == "d3"
    n, df1, df2 = 9, 9, 1
    want = np.log(1 + (n - df1 + 0.5) / (df1 + 0.5)) + 0.5 * np.log(1 + (n - df2 + 0.5) / (df2 + 0.5))
    live = index.placed(1)
    q = asked.select("query_id", "dense", "sparse", F.lit(5).alias("k"), F.lit(None).cast(dense.FILTER).alias("filter"))
    assert _lists(index, q, live, 1, 0)[1].where("rank = 1").first()["score"] == pytest.approx(want, abs=1e-6)


def test_an_empty_index(spark, tmp_path):
    index = PointIndex(spark, f"file://{tmp_path}/i")
    index.ensure(1, 2)
    results, meta = search_index(index, _asked(spark, {"query_id": "q"}))
    assert results.count() == 0 and [(r["status"], r["n_results"]) for r in meta.collect()] == [("OK", 0)]


def test_writes_shuffle_points_once_and_deletions_not_at_all(spark, tmp_path, monkeypatch):
    """An upsert has one exchange, by bucket; a deletion leaves points in their places; postings are made where the points are read, term by term what these hold."""
    from collections import Counter

    plans = []
    swap = PointIndex._swap
    monkeypatch.setattr(PointIndex, "_swap", lambda self, state, rows, *a, **k: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), swap(self, state, rows, *a, **k))[1])
    rows = [{"id": f"p{i:03}", "document_id": f"d{i}", "document_version": 1, "index_version": 1, "chunk_index": 0, "dense": [1.0, float(i)], "sparse": [(t, i + t / 8) for t in range(i % 5)]} for i in range(40)]
    points = spark.createDataFrame([tuple(r.get(f.name) for f in POINT) for r in rows], POINT)
    index = PointIndex(spark, f"file://{tmp_path}/i", buckets=2, shards=2)
    index.ensure(1, 2)
    index.upsert(points)
    index.upsert(points.where("id < 'p010'").withColumn("document_version", F.lit(2)))
    index.delete_documents(points.where("id like '%3'").select("document_id"))
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1, 0]
    held = index.placed().collect()
    assert len(held) == 36 and {r["id"] for r in held if r["document_version"] == 2} == {f"p{i:03}" for i in range(10) if i != 3}
    for b in {r["bucket"] for r in held}:
        assert [r["id"] for r in sorted((r for r in held if r["bucket"] == b), key=lambda r: r["ord"])] == sorted(r["id"] for r in held if r["bucket"] == b)
    posted = index.postings(1).collect()
    assert all(0 < len(r["ords"]) <= index_module.BLOCK and r["ords"] == sorted(r["ords"]) and r["best"] == max(r["weights"]) and r["shard"] == r["idx"] % 2 for r in posted)
    got = Counter((r["bucket"], o, r["idx"], w) for r in posted for o, w in zip(r["ords"], r["weights"], strict=True))
    assert got == Counter((r["bucket"], r["ord"], s["idx"], s["weight"]) for r in held for s in r["sparse"])
