"""Lifecycle plans, objects and metrics."""

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.plans import catalog, lifecycle
from corvane.plans.metrics import Metrics
from corvane.sources.objects import ObjectStore

def now():
    return F.lit("2024-05-01 12:00:00").cast("timestamp")


def _documents(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, size long, status string, row_version int, index_version int, chunk_count int, error_code string, error_message string")


def _doc(i, status):
    return (i, 1, status, 0, None, None, None, None)


def _jobs(spark, rows=()):
    return spark.createDataFrame(list(rows), schemas.JOB)


def test_uploads(spark):
    rows = spark.createDataFrame([("a", "x y.md", "text/markdown", 5), ("b", "z", "image/png", 5), ("c", "z", "text/plain", 0), ("d", "z", "text/plain", (50 << 20) + 1)], "document_id string, filename string, content_type string, size long")
    got = {r["id"]: r for r in lifecycle.prepare_uploads(rows, now()).collect()}
    assert (got["a"]["status"], got["a"]["filename"], got["a"]["original_object_key"]) == ("UPLOADING", "x_y.md", "documents/a/original/x_y.md")
    assert [got[i]["error"] for i in "abcd"] == [None, "UNSUPPORTED_FILE", "EMPTY", "FILE_TOO_LARGE"]


def test_an_ingestion_from_start_to_end(spark):
    docs = _documents(spark, _doc("a", "UPLOADED"), _doc("b", "READY"))
    asked = spark.createDataFrame([("a", "k1"), ("a", "k1"), ("b", "k2"), ("zz", "k3")], "document_id string, idempotency_key string")
    told, jobs, docs = lifecycle.start_ingestion(docs, _jobs(spark), asked, now())
    assert {r["idempotency_key"]: r["outcome"] for r in told.collect()} == {"k1": "started", "k2": "INVALID_STATE", "k3": "NOT_FOUND"}
    assert {r["id"]: (r["status"], r["row_version"]) for r in docs.collect()} == {"a": ("QUEUED", 1), "b": ("READY", 0)}
    again = lifecycle.start_ingestion(docs, jobs, asked.where("document_id = 'a'"), now())
    assert [r["outcome"] for r in again[0].collect()] == ["known"] and again[1].isEmpty()
    job = jobs.first()["id"]
    assert lifecycle.outbox(jobs, "DocumentIngestionRequested", "hr", now()).first()["status"] == "PENDING"
    bad = spark.createDataFrame([(job, "PARSING", "X", "boom", True)], "job_id string, stage string, error_code string, error_message string, retryable boolean")
    d1, j1 = lifecycle.fail(docs, jobs, bad, now())
    assert (j1.first()["status"], j1.first()["attempt"], str(j1.first()["available_at"])[-8:]) == ("RETRY_WAIT", 1, "12:00:01")
    assert d1.where("id = 'a'").first()["status"] == "QUEUED"
    d2, j2 = lifecycle.fail(docs, jobs, bad.withColumn("retryable", F.lit(False)), now())
    assert j2.first()["status"] == "DEAD_LETTER" and d2.where("id = 'a'").first()["status"] == "FAILED" and d2.where("id = 'a'").first()["error_code"] == "X"
    d3, j3 = lifecycle.finish(docs, jobs, spark.createDataFrame([(job, 7, 2)], "job_id string, chunk_count int, index_version int"))
    assert (j3.first()["status"], j3.first()["progress"]) == ("COMPLETED", 100)
    assert tuple(d3.where("id = 'a'").select("status", "chunk_count", "index_version").first()) == ("READY", 7, 2)
    status = {r["id"]: r["error"] for r in lifecycle.job_status(j3, spark.createDataFrame([(job,), ("none",)], "id string")).collect()}
    assert status == {job: None, "none": "NOT_FOUND"}


def test_failed_reindex_keeps_the_old_version(spark):
    docs = _documents(spark, _doc("a", "READY"), _doc("b", "DELETING"))
    told, jobs, docs = lifecycle.start_reindex(docs, _jobs(spark), spark.createDataFrame([("a", "k", 2), ("b", "l", 2)], "document_id string, idempotency_key string, target_index_version int"), now())
    assert sorted(r["outcome"] for r in told.collect()) == ["INVALID_STATE", "started"]
    bad = jobs.select(F.col("id").alias("job_id"), F.lit("VERIFYING").alias("stage"), F.lit("E").alias("error_code"), F.lit("m").alias("error_message"), F.lit(False).alias("retryable"))
    docs, _ = lifecycle.fail(docs, jobs, bad, now())
    assert docs.where("id = 'a'").first()["status"] == "READY"


def test_deletion(spark):
    docs = _documents(spark, _doc("a", "READY"), _doc("b", "QUEUED"))
    _, jobs, docs = lifecycle.start_deletion(docs, _jobs(spark), spark.createDataFrame([("a", "k"), ("b", "l")], "document_id string, idempotency_key string"), now())
    assert {r["id"]: r["status"] for r in docs.collect()} == {"a": "DELETING", "b": "QUEUED"}
    docs, _ = lifecycle.finish(docs, jobs, jobs.select(F.col("id").alias("job_id")))
    assert docs.where("id = 'a'").first()["status"] == "DELETED"


def test_the_smallest_document_of_a_key_counts(spark):
    docs = _documents(spark, *(_doc(i, "READY") for i in "abcd"))
    rows = [("c", "k", 1), (None, "k", 2), ("b", "k", 3), ("d", "k", 4), ("d", "l", 5), ("a", "l", 6)]
    for order in (rows, rows[::-1]):
        asked = spark.createDataFrame(order, "document_id string, idempotency_key string, target_index_version int").coalesce(1)
        told, jobs, after = lifecycle.start_reindex(docs, _jobs(spark), asked, now())
        assert {(r["document_id"], r["idempotency_key"], r["outcome"]) for r in told.collect()} == {
            ("b", "k", "started"), ("c", "k", "IDEMPOTENCY_CONFLICT"), ("d", "k", "IDEMPOTENCY_CONFLICT"), (None, "k", "NOT_FOUND"), ("a", "l", "started"), ("d", "l", "IDEMPOTENCY_CONFLICT"),
        }
        assert {(r["document_id"], r["target_index_version"]) for r in jobs.collect()} == {("b", 3), ("a", 6)}
        assert {r["id"]: r["status"] for r in after.collect()} == {"a": "REINDEXING", "b": "REINDEXING", "c": "READY", "d": "READY"}


def test_deletions_are_asked_for_by_every_event(spark):
    d = "/root/testdata/sf0.001"
    asked, events = catalog._requests(spark, d), spark.read.parquet(f"{d}/events.parquet").count()
    assert asked.count() == 2 * events and asked.select("document_id").distinct().count() == events
    assert catalog.start_deletions(spark, d).agg(F.sum("n")).first()[0] == 2 * events


def test_each_request_has_an_outcome(spark):
    docs = _documents(spark, _doc("a", "UPLOADED"), _doc("b", "UPLOADED"))
    asked = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("b", "k1"), ("a", "k1"), ("b", None)], "document_id string, idempotency_key string")
    told, jobs, after = lifecycle.start_ingestion(docs, _jobs(spark), asked, now())
    assert sorted((r["document_id"], r["idempotency_key"] or "", r["outcome"]) for r in told.collect()) == [("a", "k1", "started"), ("a", "k2", "INVALID_STATE"), ("b", "", "started"), ("b", "k1", "IDEMPOTENCY_CONFLICT")]
    assert jobs.count() == 2 and {r["id"]: r["row_version"] for r in after.collect()} == {"a": 1, "b": 1}
    again = {(r["document_id"], r["idempotency_key"]): (r["outcome"], r["job_id"]) for r in lifecycle.start_ingestion(after, jobs, asked, now())[0].collect()}
    assert again["a", "k1"] == ("known", jobs.where("idempotency_key = 'k1'").first()["id"]) and again["b", "k1"] == ("IDEMPOTENCY_CONFLICT", None)


def test_configs(spark):
    wanted = {"version": 1, "dense_model": "m", "dense_dimension": 8, "sparse_model": "s", "chunk_size_tokens": 40, "chunk_overlap_tokens": 8}
    configs = lifecycle.provision(spark.createDataFrame([], schemas.INDEX_CONFIG), wanted)
    assert lifecycle.active_config(configs)["version"] == 1
    assert lifecycle.provision(configs, wanted).count() == 1
    with pytest.raises(ValueError, match="dense_dimension"):
        lifecycle.provision(configs, wanted | {"dense_dimension": 9})
    with pytest.raises(ValueError, match="impossible"):
        lifecycle.provision(configs, wanted | {"chunk_overlap_tokens": 40})
    two = configs.unionByName(configs.withColumn("version", F.lit(2)).withColumn("active", F.lit(False)))
    assert lifecycle.active_config(lifecycle.activate(two, 2))["version"] == 2
    with pytest.raises(ValueError, match="no index config"):
        lifecycle.activate(two, 3)


def test_rules(spark):
    bad = lifecycle.invalid_documents(_documents(spark, _doc("a", "READY"), _doc("b", "NOWHERE"), ("c", 0, "READY", 0, None, None, None, None)))
    assert {r["id"]: r["rule"] for r in bad.collect()} == {"b": "status", "c": "size"}


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}", "hr-docs")
    store.ensure_bucket()
    store.ensure_bucket()
    store.put("documents/a/original/x.md", b"one")
    store.put("documents/a/original/x.md", b"three")
    assert store.get("documents/a/original/x.md") == b"three" and store.head("documents/a/original/x.md")["size"] == 5
    assert [tuple(r) for r in store.listing().collect()] == [("documents/a/original/x.md", 5)]
    store.delete("documents/a/original/x.md")
    store.delete("documents/a/original/x.md")
    assert not store.exists("documents/a/original/x.md")
    with pytest.raises(FileNotFoundError):
        store.get("documents/a/original/x.md")


def test_metrics(spark):
    m = Metrics()
    m.add("searches", status="ok")
    m.add("searches", status="ok")
    m.observed(spark.range(5), "results").collect()
    assert m.render() == 'results 5\nsearches{status="ok"} 2'


def test_a_refused_request_leaves_the_key_free(spark):
    docs = _documents(spark, _doc("b", "UPLOADED"), _doc("c", "DELETED"), _doc("d", "UPLOADED"), _doc("e", "UPLOADED"))
    asked = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2"), ("d", "k2"), ("e", "k2"), ("e", "k3")], "document_id string, idempotency_key string")
    told, jobs, _ = lifecycle.start_ingestion(docs, _jobs(spark), asked, now())
    assert sorted(tuple(r) for r in told.select("document_id", "idempotency_key", "outcome").collect()) == [
        ("a", "k1", "NOT_FOUND"), ("b", "k1", "started"), ("c", "k2", "INVALID_STATE"), ("d", "k2", "started"), ("e", "k2", "IDEMPOTENCY_CONFLICT"), ("e", "k3", "started"),
    ]
    again, _, _ = lifecycle.start_ingestion(docs, jobs, asked, now())
    assert {(r["document_id"], r["outcome"]) for r in again.where("idempotency_key = 'k2'").collect()} == {("c", "IDEMPOTENCY_CONFLICT"), ("d", "known"), ("e", "IDEMPOTENCY_CONFLICT")}


def test_requests_are_gone_through_in_order(spark):
    """Against a plain loop: requests that wait for one another, by moment, document and key."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(6)
    asked = sorted({(rng.choice([None, rng.randrange(9)]), f"d{rng.randrange(12)}", f"k{rng.randrange(12)}") for _ in range(90)}, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    asked = list({r[1:]: r for r in reversed(asked)}.values())  # one moment for a pair
    states = {f"d{i}": ["UPLOADED", "READY", None, "FAILED"][i % 4] for i in range(12)}
    jobs, started, want = {}, set(), {}
    for _, d, k in sorted(asked, key=lambda r: (r[0] is None, r[0] or 0, *r[1:])):
        if k in jobs:
            want[d, k] = "IDEMPOTENCY_CONFLICT"
        elif states[d] is None:
            want[d, k] = "NOT_FOUND"
        elif states[d] == "READY" or d in started:
            want[d, k] = "INVALID_STATE"
        else:
            want[d, k], jobs[k] = "started", d
            started.add(d)
    rows = [(d, k, None if t is None else datetime(2024, 1, 1) + timedelta(days=t)) for t, d, k in asked]
    docs = _documents(spark, *(_doc(d, s) for d, s in states.items() if s))
    told, _, _ = lifecycle.start_ingestion(docs, _jobs(spark), spark.createDataFrame(rows, "document_id string, idempotency_key string, requested_at timestamp"), now())
    assert {(r["document_id"], r["idempotency_key"]): r["outcome"] for r in told.collect()} == want


def test_uploads_are_checked_at_the_start(spark):
    docs = _documents(spark, *(_doc(x, "UPLOADED") for x in "abcd")).withColumn("size", F.lit(5).cast("long")).withColumn("checksum", F.when(F.col("id").isin("c", "d"), "s"))
    asked = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x"), ("d", "4", "s"), ("e", "5", "x")], "document_id string, idempotency_key string, checksum string")
    objects = spark.createDataFrame([("a", 5), ("b", 6), ("c", 5), ("d", 5)], "document_id string, object_size long")
    told, _, after = lifecycle.start_ingestion(docs, _jobs(spark), asked, now(), objects)
    assert {r["document_id"]: r["outcome"] for r in told.collect()} == {"a": "started", "b": "SIZE_MISMATCH", "c": "CHECKSUM_CONFLICT", "d": "started", "e": "NOT_FOUND"}
    assert {r["id"]: r["checksum"] for r in after.collect()} == {"a": "x", "b": None, "c": "s", "d": "s"}
