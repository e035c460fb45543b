"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _TS, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: States of documents and jobs, stages with their progress, kinds of events.
DOCUMENT_STATES = ("UPLOADING", "UPLOADED", "QUEUED", "PROCESSING", "READY", "FAILED", "REINDEXING", "DELETING", "DELETE_FAILED", "DELETED")
EXCLUDED_STATES = ("DELETING", "DELETE_FAILED", "DELETED")
JOB_STATES = ("QUEUED", "PROCESSING", "RETRY_WAIT", "COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER")
STAGE_PROGRESS = {"DOWNLOAD": 10, "PARSING": 25, "MARKDOWN_UPLOAD": 35, "CHUNKING": 45, "DENSE_EMBEDDING": 65, "SPARSE_EMBEDDING": 80, "QDRANT_UPSERT": 90, "VERIFYING": 96, "FINALIZING": 100}
EVENT_TYPES = (
    "DocumentIngestionRequested", "DocumentIngestionCompleted", "DocumentIngestionFailed", "DocumentDeletionRequested", "DocumentDeleted", "DocumentDeletionFailed",
    "DocumentReindexRequested", "DocumentReindexCompleted", "DocumentReindexFailed",
)
#: From which states each state can be reached.
REACHED_FROM = {
    "UPLOADED": ("UPLOADING",), "QUEUED": ("UPLOADED", "FAILED"), "PROCESSING": ("QUEUED", "PROCESSING", "UPLOADED", "FAILED"), "READY": ("PROCESSING", "REINDEXING", "READY"), "REINDEXING": ("UPLOADED", "FAILED", "READY", "REINDEXING"),
    "DELETING": ("UPLOADED", "FAILED", "READY", "DELETE_FAILED", "DELETING"), "DELETED": ("DELETING",), "FAILED": ("UPLOADING", "UPLOADED", "QUEUED", "PROCESSING"), "DELETE_FAILED": ("DELETING",),
}

DOCUMENT = _struct(
    id=_S, filename=_S, content_type=_S, size=_L, checksum=_S, status=_S, document_version=_I, row_version=_I, index_version=_I, chunk_count=_I, parser_version=_S, chunker_version=_S,
    original_object_key=_S, markdown_object_key=_S, error_code=_S, error_message=_S, created_at=_TS, updated_at=_TS,
)
JOB = _struct(
    id=_S, kind=_S, document_id=_S, status=_S, stage=_S, progress=_I, attempt=_I, idempotency_key=_S, lease_owner=_S, lease_expires_at=_TS, heartbeat_at=_TS, cancel_requested=_B, available_at=_TS,
    source_index_version=_I, target_index_version=_I, created_at=_TS,
)
INDEX_CONFIG = _struct(version=_I, dense_model=_S, dense_dimension=_I, sparse_model=_S, chunk_size_tokens=_I, chunk_overlap_tokens=_I, active=_B)
EVENT = _struct(
    schema_version=_I, event_id=_S, event_type=_S, occurred_at=_TS, domain=_S, document_id=_S, job_id=_S, attempt=_I, trace_id=_S, index_version=_I, target_index_version=_I, stage=_S, error_code=_S, error_message=_S, chunk_count=_I,
)
POINT = T.StructType([
    T.StructField("id", _S), T.StructField("document_id", _S), T.StructField("document_version", _I), T.StructField("index_version", _I), T.StructField("chunk_index", _L), T.StructField("filename", _S), T.StructField("content_type", _S),
    T.StructField("text", _S), T.StructField("section_path", T.ArrayType(_S)), T.StructField("page_from", _I), T.StructField("page_to", _I), T.StructField("table_id", _S), T.StructField("table_markdown", _S),
    T.StructField("created_at", _TS), T.StructField("dense", T.ArrayType(_D)), T.StructField("sparse", T.ArrayType(_struct(idx=_L, weight=_D))),
])
#: What a search may ask of a point beside nearness (all fields may be null), and what that is held against; moments are microseconds.
FILTER = _struct(document_ids=T.ArrayType(_S), document_version=_I, created_from=_L, created_to=_L)
ABOUT = _struct(document_id=_S, document_version=_I, created_at=_L)
#: A block of postings of the index.
POSTED = _struct(idx=_L, block=_I, best=_D, ords=T.ArrayType(_I), weights=T.ArrayType(_D), index_version=_I, bucket=_I, shard=_I)
