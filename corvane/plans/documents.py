"""Reading the control tables: documents found by state and name, their records and metadata, reindex jobs by target.

A batch of requests is one join; a request that can't be answered has an error in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.identity import rfc3339
from corvane.operators.control import find

_RECORD = ("filename", "content_type", "size", "status", "document_version", "index_version", "chunk_count")
_MORE = ("checksum", "parser_version", "chunker_version", "error_code", "error_message")


def records(documents: DataFrame, *more: str) -> DataFrame:
    """The public columns of documents: document_id, the record, more columns, and the moments as RFC 3339. Columns that the table lacks are null."""
    own = lambda c: F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c)
    moments = [(rfc3339(F.col(c)) if c in documents.columns else F.lit(None).cast("string")).alias(c) for c in ("created_at", "updated_at")]
    return documents.select(F.col("id").alias("document_id"), *(own(c) for c in (*_RECORD, *more)), *moments)


def find_documents(documents: DataFrame, *, status: str | None = "READY", query: str | None = None, filename: str | None = None, limit: int = 20) -> DataFrame:
    """Records of a state, READY if none is named and any state for None, whose file name holds both texts in any case; newest first, then by id. A limit that isn't from 1 to 100 is an error."""
    if not 1 <= limit <= 100:
        raise ValueError("the limit must be from 1 to 100")
    wanted = None if status is None else F.col("status") == status
    return records(find(documents, status=wanted, name=filename, query=query, newest=(F.desc("created_at"), F.asc("id")), limit=limit))


def document_metadata(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Metadata of the documents asked for (document_id), a row for each id, with error NOT_FOUND where there is none."""
    found = records(documents, *_MORE)
    wanted = asked.select("document_id").distinct().join(found, "document_id", "left")
    return wanted.withColumn("error", F.when(F.col("status").isNull(), "NOT_FOUND"))


def indexed_by_checksum(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (checksum, document_version) with the smallest id of a READY document that has them, or null."""
    keys = ["checksum", "document_version"]
    ready = documents.where("status = 'READY'").groupBy(*keys).agg(F.min("id").alias("document_id"))
    return asked.join(ready, keys, "left")


def reindex_targets(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (document_id, target_index_version) with the reindex job of that pair (job_id, status), the newest where several are there; nulls where none is."""
    keys = ["document_id", "target_index_version"]
    newest: Column = F.max_by(F.struct(F.col("id").alias("job_id"), "status"), F.struct("created_at", "id"))
    own = jobs.where("kind = 'reindex'").groupBy(*keys).agg(newest.alias("_j"))
    return asked.join(own, keys, "left").select(*asked.columns, "_j.job_id", "_j.status")
