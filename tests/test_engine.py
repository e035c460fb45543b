"""Ranking, control, index, ingestion, streams and evaluation."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import encoders, text
from corvane.operators import control, evaluate, lexical, ranking
from corvane.plans import ingest
from corvane.sources import parsers
from corvane.sources.index import PointIndex
from corvane.streaming import consume

CONFIG = {"version": 1, "dense_dimension": 16, "chunk_size_tokens": 40, "chunk_overlap_tokens": 8}


def _list(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id string, rank long")


def test_fusion_prefers_what_both_lists_have(spark):
    fused = ranking.fuse([_list(spark, [(1, "a", 1), (1, "b", 2)]), _list(spark, [(1, "b", 1), (1, "c", 2)])])
    rows = fused.orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["b", "a", "c"]
    assert [r["first_list"] for r in rows] == [0, 0, 1]
    assert rows[0]["score"] == round(1 / 62 + 1 / 61, 9)


def test_gate(spark):
    rows = spark.createDataFrame([(0.5, 0.1), (0.4, 0.9), (None, 0.5), (None, 0.7), (None, None)], "r double, d double")
    got = [r["low"] for r in rows.select(ranking.low_confidence(F.col("r"), F.col("d")).alias("low")).collect()]
    assert got == [False, True, True, False, False]


def test_expansion_rule(spark):
    rows = spark.createDataFrame([(0, False, None), (3, True, 0.1), (3, True, 0.5), (3, False, None)], "n int, reranked boolean, top double")
    assert [r["e"] for r in rows.select(ranking.needs_expansion(F.col("n"), F.col("reranked"), F.col("top")).alias("e")).collect()] == [True, True, False, False]


def test_results_prefer_whole_tables(spark):
    ranked = spark.createDataFrame([(1, 7, 0.5, 1), (1, 8, 0.4, 2)], "query_id long, doc_id long, score double, rank long")
    payload = spark.createDataFrame([(7, "row", "| whole | table |"), (8, "plain", None)], "doc_id long, text string, table_markdown string")
    rows = ranking.results(ranked, payload, chars=9).orderBy("rank").collect()
    assert [(r["source_id"], r["text"]) for r in rows] == [("S1", "| whole |"), ("S2", "plain")]


def test_unknown_reranked_ids(spark):
    one = spark.createDataFrame([(1, "a"), (1, "x")], "query_id long, doc_id string")
    assert [r["doc_id"] for r in ranking.unknown_ids(one, one.where("doc_id = 'a'")).collect()] == ["x"]


def test_saturation_and_length(spark):
    docs = spark.createDataFrame([(1, "apple"), (2, "apple apple apple"), (3, "apple " + "filler words " * 30)], "doc_id long, text string")
    w = {r["doc_id"]: r["weight"] for r in lexical.encode(lexical.postings(docs), 10).where("term = 'apple'").collect()}
    assert w[2] > w[1] > w[3] and w[2] < 3 * w[1]


def test_inflections_meet(spark):
    docs = spark.createDataFrame([(1, "операционные затраты"), (2, "операционных затрат")], "doc_id long, text string")
    found = lexical.stemmed(docs).groupBy("term").count().collect()
    assert {r["count"] for r in found} == {2}


def test_stems_and_places_by_document(spark, monkeypatch):
    monkeypatch.setattr(encoders, "REMEMBERED", 3)
    texts = [None, "", "the of", "Running runs RUN операций операциями", "run, jumping. jumped? jumps", "naïve " * 40 + "word " * 7, "run, jumping. jumped? jumps"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    stems, places = Counter(), Counter()
    for r in docs.select("doc_id", text.terms(F.col("text")).alias("t")).collect():
        for t in r["t"]:
            stems[r["doc_id"], encoders.stem_word(t), len(r["t"])] += 1
            places[r["doc_id"], encoders.place_of(encoders.stem_word(t), 5), len(r["t"])] += 1
    assert {(r["doc_id"], r["term"], r["len"]): r["tf"] for r in lexical.stemmed(docs).collect()} == stems
    assert {(r["doc_id"], r["idx"], r["len"]): r["tf"] for r in lexical.hashed(docs, vocabulary=5).collect()} == places
    nothing = lexical.hashed(docs.limit(0))
    assert nothing.columns == ["doc_id", "idx", "tf", "len"] and not nothing.count()


def test_backoff(spark):
    got = spark.range(1, 10).select(control.backoff(F.col("id")).alias("d")).collect()
    assert [r["d"] for r in got] == [1, 3, 10, 30, 30, 30, 30, 30, 30]


@pytest.mark.parametrize(("a", "b", "ok"), [("UPLOADING", "UPLOADED", True), ("FAILED", "QUEUED", True), ("QUEUED", "PROCESSING", True), ("PROCESSING", "READY", True), ("READY", "DELETING", True), ("DELETING", "DELETED", True), ("READY", "REINDEXING", True), ("DELETED", "PROCESSING", False), ("UPLOADING", "DELETING", False), ("QUEUED", "READY", False)])
def test_transitions(spark, a, b, ok):
    docs = spark.createDataFrame([("d", a, 0)], "id string, status string, row_version int")
    row = control.transition(docs, spark.createDataFrame([("d", b)], "id string, to string")).first()
    assert (row["status"], row["row_version"], row["illegal"]) == ((b, 1, False) if ok else (a, 0, True))


def test_requests(spark):
    rows = spark.createDataFrame([("q", 10, 50), (" ", 10, 50), ("x" * 4001, 10, 50), ("q", 0, 50), ("q", 51, 60), ("q", 10, 201), ("q", 10, 5)], "q string, n int, c int")
    got = [r["e"] for r in rows.select(control.request_error(F.col("q"), F.col("n"), F.col("c")).alias("e")).collect()]
    assert got == [None, "EMPTY_QUERY", "QUERY_TOO_LONG", "BAD_LIMIT", "BAD_LIMIT", "BAD_CANDIDATES", "BAD_CANDIDATES"]


def test_failures_by_kind(spark):
    rows = spark.createDataFrame([("ingestion", "dead_letter"), ("deletion", "dead_letter"), ("reindex", "dead_letter"), ("ingestion", "retry")], "k string, r string")
    job, doc = control.after_job_failure(F.col("k"), F.col("r"))
    assert [(x["j"], x["d"]) for x in rows.select(job.alias("j"), doc.alias("d")).collect()] == [("DEAD_LETTER", "FAILED"), ("DEAD_LETTER", "DELETE_FAILED"), ("DEAD_LETTER", "READY"), ("RETRY_WAIT", None)]


def test_cancel_and_heartbeat(spark):
    jobs = spark.createDataFrame([(1, "PROCESSING", "w", None, None, False), (2, "COMPLETED", "v", None, None, False)], "id long, status string, lease_owner string, lease_expires_at timestamp, heartbeat_at timestamp, cancel_requested boolean")
    flagged = control.cancel(jobs, spark.createDataFrame([(1,), (2,)], "id long")).orderBy("id").collect()
    assert [r["cancel_requested"] for r in flagged] == [True, False]
    beat = control.heartbeat(jobs, "w", F.lit("2024-01-01 00:00:00").cast("timestamp"), 60).orderBy("id").collect()
    assert str(beat[0]["lease_expires_at"]).endswith("00:01:00") and beat[1]["heartbeat_at"] is None


def _documents(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.md", "text/markdown", 1, t) for i, t in rows], "document_id string, filename string, content_type string, document_version int, markdown string")


def test_index_life(spark, tmp_path):
    index = PointIndex(spark, f"file://{tmp_path}/index")
    docs = _documents(spark, ("a", "# Policy\n" + "word " * 60), ("b", "| x |\n|---|\n| 1 |"), ("c", ""))
    rows = {r["document_id"]: r for r in ingest.ingest(index, docs, CONFIG).collect()}
    assert (rows["a"]["status"], rows["a"]["chunk_count"]) == ("READY", 2)
    assert rows["b"]["chunk_count"] == 2 and rows["c"]["status"] == "FAILED"
    before = {r["id"] for r in index.points().collect()}
    index.upsert(ingest.points(docs.where("document_id = 'a'"), CONFIG))  # again: the same ids
    assert {r["id"] for r in index.points().collect()} == before
    assert index.verify("a", 1, 2, [next(iter({r["id"] for r in index.points().where("document_id = 'a'").collect()}))])
    with pytest.raises(ValueError, match="missing"):
        index.cutover(2)
    state = ingest.reindex(index, docs.where("document_id != 'c'"), CONFIG | {"version": 2, "chunk_size_tokens": 20})
    assert state["active"] == 2 and {r["index_version"] for r in index.points().collect()} == {2}
    with pytest.raises(ValueError):  # a reindex that leaves documents out fails and cleans up
        ingest.reindex(index, docs.where("document_id = 'a'"), CONFIG | {"version": 3})
    assert index.state()["active"] == 2 and {r["index_version"] for r in index.points().collect()} == {2}
    with pytest.raises(ValueError, match="INVALID_DIMENSION"):
        index.upsert(index.points().withColumn("dense", F.array(F.lit(1.0))))
    with pytest.raises(ValueError, match="dimensions"):
        index.ensure(2, 99)
    assert ingest.delete(index, docs.where("document_id = 'a'").select("document_id"))
    assert {r["document_id"] for r in index.active().collect()} == {"b"}
    live = control.search_filter(index.points(), index_version=2, created_from="2000-01-01", created_to="2999-01-01", excluded=spark.createDataFrame([("b",)], "document_id string"))
    assert live.isEmpty()


def _event(i, **more):
    return json.dumps({"schema_version": 1, "event_id": f"e{i}", "event_type": "DocumentIngestionRequested", "occurred_at": "2024-01-01T00:00:00Z", "domain": "hr", "document_id": f"d{i}", "job_id": f"j{i}", "attempt": 0} | more)


def test_consumer(spark, tmp_path):
    source, sink = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "1.json").write_text("\n".join([_event(1), _event(2), _event(1), _event(3, domain="it"), _event(4, event_type="Nonsense"), "not json", _event(5, attempt=4)]))

    def run(events):
        return events.select("event_id", (F.col("event_id") == "e1").alias("ok"), F.lit(True).alias("retryable"))

    def go():
        consume.consume(spark, f"file://{source}", sink, f"file://{tmp_path}/check", domain="hr", kinds=("DocumentIngestionRequested",), run=run).awaitTermination()

    go()
    routes = {r["event_id"]: (r["route"], r["error"], r["delay"]) for r in spark.read.parquet(sink).collect()}
    assert routes["e1"] == ("done", None, None) and routes["e2"] == ("retry", None, 1.0)
    assert routes["e3"][:2] == ("dead_letter", "WRONG_DOMAIN") and routes["e4"][:2] == ("dead_letter", "UNKNOWN_EVENT") and routes[None][0] == "dead_letter"
    assert routes["e5"][0] == "dead_letter"
    import shutil

    kept = tmp_path / "kept"
    shutil.copytree(tmp_path / "out", kept)
    shutil.rmtree(tmp_path / "out")  # earlier batches aren't read: the state knows
    (source / "2.json").write_text("\n".join([_event(1), _event(6), _event(2, attempt=1), "not json"]))
    go()
    assert sorted((r["event_id"], r["attempt"]) for r in spark.read.parquet(sink).collect()) == [("e2", 1), ("e6", 0)]
    for part in kept.glob("batch=*"):
        shutil.copytree(part, tmp_path / "out" / part.name)
    seen = [r["event_id"] for r in spark.read.parquet(sink).collect()]
    assert seen.count("e1") == 1 and seen.count("e6") == 1
    assert consume.redrive(spark, sink, spark.createDataFrame([("e5",)], "event_id string"), f"file://{source}") == 1
    go()
    again = spark.read.parquet(sink).where("event_id = 'e5'").collect()
    assert len(again) == 1  # a dead letter is an effect that is recorded; only its first delivery counts


def test_parsing(spark):
    files = spark.createDataFrame([("a", bytearray(b" hi "), "text/plain"), ("b", bytearray("é".encode("latin-1")), "text/csv"), ("c", bytearray(b"  "), "text/markdown"), ("d", bytearray(b"x"), "image/png"), ("e", bytearray(b"x"), "application/pdf")], "path string, content binary, content_type string")
    got = {r["path"]: (r["markdown"], r["error"]) for r in parsers.parse(files, {"layout": lambda data: "# parsed"}).collect()}
    assert got == {"a": ("hi", None), "b": ("é", None), "c": (None, "EMPTY_DOCUMENT"), "d": (None, "UNSUPPORTED_FILE"), "e": ("# parsed", None)}

    def broken(data):
        raise ValueError("no such object")

    got = {r["path"]: (r["markdown"], r["error"]) for r in parsers.parse(files, {"layout": broken}).collect()}
    assert got["e"] == (None, "PARSE_FAILED") and got["a"] == ("hi", None)


def test_gold_and_report(spark):
    corpus, cases = parsers.gold(spark, json.dumps({"corpus": [{"fixture": "f.md", "filename": "F"}], "cases": [{"id": "c1", "query": "q", "must_contain": ["x", "y"]}, {"id": "c2", "query": "q", "must_contain": ["z"]}]}))
    ranked = spark.createDataFrame([("c1", "x alone", 1), ("c1", "x and y", 2), ("c2", "none", 1)], "query_id string, text string, rank long")
    hits = evaluate.first_hits(cases, evaluate.relevant(ranked, cases.select("query_id", "needles")))
    row = evaluate.report(hits).first()
    assert corpus.count() == 1 and (row["n_cases"], row["recall"], row["mrr"]) == (2, 0.5, 0.25)
    assert evaluate.report(hits.where("false")).first()["mrr"] == 0.0


def test_streams_are_counted(spark, tmp_path):
    import time

    from corvane.plans.metrics import Metrics, StreamCounts

    metrics = Metrics()
    listener = StreamCounts(metrics)
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            (tmp_path / f"{i}.txt").write_text("\n".join("x" * (i + 1)))
        stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"file://{tmp_path}/*.txt")
        stream.writeStream.queryName("lines").foreachBatch(lambda batch, n: batch.count()).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    told = dict(line.rsplit(" ", 1) for line in metrics.render().splitlines())
    assert told['stream_batches_total{query="lines"}'] == "3" and told['stream_input_rows_total{query="lines"}'] == "6" and told['stream_starts_total{query="lines"}'] == "1"


def test_dense_search_sends_no_query_twice_to_a_part(spark, monkeypatch):
    """Whatever groups the queries are dealt to and however often candidates are cut, the list is that of all pairs; copies of one vector don't fill the sample."""
    import numpy as np

    from corvane.operators import dense

    monkeypatch.setattr(dense, "GROUP", 40 * 8)
    monkeypatch.setattr(dense, "HELD", 60)
    monkeypatch.setattr(dense, "SAMPLE", 64 * 8)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    v[100:300] = v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in dense.dense_top(rows, asked, 7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(u[::4] @ u.T, 9)
    assert got == {(4 * q, n + 1): int(i) for q, s in enumerate(scores) for n, i in enumerate(np.lexsort((np.arange(400), -s))[:7])}
    sample, _ = dense.sampled(rows, "embedding", [dense.F.lit(None).alias("about")])
    assert len(np.unique(np.round(sample, 9), axis=0)) > 8  # the 201 copies aren't all there is
    assert not hasattr(dense, "written")  # blocks and queries aren't joined by block any more


def test_most_frequent_tokens_are_counted_where_they_stand(spark):
    """Ids of one row have no token shuffled; rows that share an id, or have none, add up."""
    rows = [(1, "b a B c c\x1cC"), (2, None), (3, " "), (4, "é e É"), (5, "x y"), (5, "y z"), (None, "q"), (None, "q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, "c", 3, 1), (1, "b", 2, 2), (4, "é", 2, 1), (4, "e", 1, 2), (5, "y", 2, 1), (5, "x", 1, 2), (None, "q", 2, 1), (None, "r", 1, 2)}
    assert {tuple(r) for r in lexical.top_tokens(docs, 2).collect()} == want
    alone = lexical.top_tokens(docs.where("doc_id < 5"), 2)
    assert {tuple(r) for r in alone.collect()} == {w for w in want if w[0] in (1, 4)}
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ask", ["rerank_jaccard", "result_projection", "first_hits"])
def test_lexical_searches_tokenize_documents_once(spark, monkeypatch, tmp_path, ask):
    """One pass over the documents finds lengths, frequencies and both lists' matches; candidates then meet the texts without a shuffle of these."""
    from corvane.plans import catalog

    given = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        given.add(1)
        return t

    rows = [(i, f"{'apple' if i % 3 else 'pear'} word{i} plum") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, "apple plum"), (40, "word7 zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = catalog.queries()[ask](spark, str(tmp_path)).collect()
    monkeypatch.setattr(lexical, "matches", lambda docs, *a, _m=lexical.matches: _m(docs.withColumn("text", seen("text")), *a))
    found = catalog.queries()[ask](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain)) and plain
    assert given.value == len(rows)


def test_sparse_search_of_many_queries_makes_no_row_for_a_pair(spark, monkeypatch):
    """Whatever blocks, groups and shelves there are, the lists are those of the join by term; ids of several texts, texts without words and long ones too."""
    import random

    from corvane.operators import sparse

    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400:03}"
    texts = [None, "", "the of", "w001 " * 500] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[9]), (7, texts[7]), (500, texts[20])]  # copies, and one id of three texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = docs.where("doc_id % 3 = 1").withColumnRenamed("doc_id", "query_id")
    want = {tuple(r) for r in lexical.sparse_dot(docs, asked, 6).collect()}
    assert len(want) > 250
    for bounds in ({}, {"BLOCK": 7, "POSTINGS": 200, "ASKED": 90, "GROUP": 300, "SHELF": 400, "PARTS": 3}):
        for name, value in bounds.items():
            monkeypatch.setattr(sparse, name, value)
        found = sparse.sparse_top(docs, asked, 6)
        got = {tuple(r) for r in found.collect()}
        assert {r[:2] + r[3:] for r in got} == {r[:2] + r[3:] for r in want}
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString().replace("\n", " ").split("MapInArrow")[0]
    assert sparse.sparse_top(docs, asked.where("query_id is null"), 6).count() == 0
    named = sparse.sparse_top(docs.selectExpr("concat('d', lpad(doc_id, 4, '0')) AS doc_id", "text"), asked, 6)
    assert {(r[0], int(r[1][1:]), r[3]) for r in named.collect()} == {r[:2] + r[3:] for r in want}


def test_hybrid_search_scores_lists_once_and_passes_no_pairs_on(spark, monkeypatch):
    """Points, lists, fused and reranked rows are tables, and nothing that leaves a step has more than the lists' rows."""
    from corvane.plans import catalog, search

    seen = {}
    monkeypatch.setattr(search, "written", lambda df, name, f=search.written: seen.setdefault(name, f(df, name)))
    results, meta = search.search(*catalog._points(spark, "/root/testdata/sf0.001"), limit=4, most=9)
    assert set(seen) == {"dense", "sparse", "fused", "reranked"}
    n = meta.count()
    assert n > 5 and results.count() == 4 * n
    assert all(seen[x].groupBy("query_id").count().where("count > 9").isEmpty() for x in ("dense", "sparse", "fused"))
    assert "texts" not in seen and {c for c, t in search.candidates(*catalog._points(spark, "/root/testdata/sf0.001"), seen["fused"], 9).dtypes if t == "array<string>"} == {"text", "query"}


def test_the_gate_reads_stored_lists_only(spark):
    """Meta rows come from tables of lists and reranked rows: no search, no text and no vector is in their plan."""
    from corvane.plans import catalog

    gate = catalog.queries()["low_confidence_gate"](spark, "/root/testdata/sf0.001")
    plan = gate._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("MapInArrow", "ArrowEvalPython", "embedding", "regexp_extract_all")) and gate.where("n_results > 0").count() == gate.count() > 5


def test_variants_are_searched_without_a_join_by_term(spark, monkeypatch):
    """The lists of variants are made by blocks: what is stored as the sparse list has no join and no sum for a pair in its plan, and is what the join by term gives."""
    from corvane.plans import catalog, search

    plans = {}

    def kept(df, name, f=search.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return f(df, name)

    monkeypatch.setattr(search, "written", kept)
    points, asked = catalog._points(spark, "/root/testdata/sf0.001")
    variants = asked.select("query_id", F.explode(F.array(F.lit(0), F.lit(1000))).alias("n"), "text", "embedding")
    variants = variants.select("query_id", (F.col("query_id") + F.col("n")).alias("variant_id"), F.substring("text", F.when(F.col("n") == 0, 1).otherwise(30), F.lit(60)).alias("text"), "embedding")
    dense, sparse = search.expansion_lists(points, variants, 5)
    assert "MapInArrow" in plans["sparse"] and not any(x in plans["sparse"] for x in ("Join", "HashAggregate"))
    plain = lexical.sparse_dot(points, variants.select(F.col("variant_id").alias("query_id"), "text"), 5)
    assert Counter(tuple(r) for r in sparse.collect()) == Counter((r["query_id"] % 1000, r["doc_id"], r["rank"]) for r in plain.collect())
