"""Look-ups in the control tables."""

from datetime import datetime

import pytest

from corvane.plans import documents
from corvane.schemas import DOCUMENT, JOB


def _rows(spark, schema, *rows):
    return spark.createDataFrame([[r.get(f.name) for f in schema] for r in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    day = lambda n: datetime(2024, 1, n, 0, 0, 0, 5 * n)
    return _rows(
        spark, DOCUMENT,
        {"id": "a", "filename": "Annual_100%.pdf", "status": "READY", "checksum": "s", "document_version": 1, "created_at": day(1)},
        {"id": "b", "filename": "annual report.pdf", "status": "READY", "checksum": "s", "document_version": 1, "created_at": day(3)},
        {"id": "c", "filename": "annual.pdf", "status": "FAILED", "checksum": "s", "document_version": 2, "error_code": "X", "created_at": day(2)},
    )


def test_finding(docs):
    ids = lambda **given: [r["document_id"] for r in documents.find_documents(docs, **given).collect()]
    assert ids() == ["b", "a"] and ids(status="FAILED") == ["c"] and ids(status=None, limit=2) == ["b", "c"]
    assert ids(query="ANNUAL", filename="report") == ["b"] and ids(query="100%") == ["a"] and ids(query="_1") == ["a"] and ids(query="nothing") == []
    for limit in (0, 101):
        with pytest.raises(ValueError, match="limit"):
            documents.find_documents(docs, limit=limit)


def test_metadata(spark, docs):
    asked = spark.createDataFrame([("c",), ("x",), ("c",), (None,)], "document_id string")
    found = {r["document_id"]: r for r in documents.document_metadata(docs, asked).collect()}
    assert set(found) == {"c", "x", None} and found["x"]["error"] == "NOT_FOUND" == found[None]["error"]
    assert (found["c"]["error_code"], found["c"]["created_at"], found["c"]["error"]) == ("X", "2024-01-02T00:00:00.000010Z", None)


def test_contents_and_targets(spark, docs):
    asked = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "checksum string, document_version int")
    assert {(r[0], r[1]): r["document_id"] for r in documents.indexed_by_checksum(docs, asked).collect()} == {("s", 1): "a", ("s", 2): None, ("t", 1): None}
    jobs = _rows(
        spark, JOB,
        {"id": "1", "kind": "reindex", "document_id": "a", "status": "FAILED", "target_index_version": 2, "created_at": datetime(2024, 1, 1)},
        {"id": "2", "kind": "reindex", "document_id": "a", "status": "QUEUED", "target_index_version": 2, "created_at": datetime(2024, 1, 2)},
        {"id": "3", "kind": "ingestion", "document_id": "b", "status": "QUEUED", "target_index_version": 2, "created_at": datetime(2024, 1, 2)},
    )
    wanted = spark.createDataFrame([("a", 2), ("a", 3), ("b", 2)], "document_id string, target_index_version int")
    assert {(r[0], r[1]): (r["job_id"], r["status"]) for r in documents.reindex_targets(jobs, wanted).collect()} == {("a", 2): ("2", "QUEUED"), ("a", 3): (None, None), ("b", 2): (None, None)}
