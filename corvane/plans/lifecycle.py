"""Document life as batch plans: uploads, jobs, finishing and failing, index configs.

Tables are those of corvane.schemas. A plan takes requests as a DataFrame and returns the changed tables and one row for each
request with its outcome, so that a caller writes them in one commit. What the control plane does row by row under locks is one pass here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import identity
from corvane.operators import control
from corvane.sources.scratch import written

#: What may be uploaded, and from which states deletion and reindexing may start.
UPLOAD_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/markdown")
DELETABLE = ("UPLOADED", "FAILED", "READY", "DELETE_FAILED")
REINDEXABLE = ("UPLOADED", "FAILED", "READY")


def prepare_uploads(requests: DataFrame, now: Column) -> DataFrame:
    """requests (document_id, filename, content_type, size) as document rows in UPLOADING, or with error."""
    error = control.upload_error(F.col("size"), F.col("content_type"), UPLOAD_TYPES)
    name = identity.sanitize_filename(F.col("filename"))
    return requests.select(
        F.col("document_id").alias("id"), name.alias("filename"), "content_type", "size", F.when(error.isNull(), "UPLOADING").alias("status"), F.lit(1).alias("document_version"), F.lit(0).alias("row_version"),
        identity.original_key(F.col("document_id"), F.col("filename")).alias("original_object_key"), now.alias("created_at"), error.alias("error"),
    )


def _started(able: DataFrame) -> DataFrame:
    """(document_id, _key, _at) of the requests that start, of able ones (with their place _at): as if gone through in order, each document and each key once.

    In a round those start that come first for both their document and their key; the others of these documents and keys drop out. What is
    left goes to the next round, so rounds are as many as requests wait for one another in a row. At least one starts in each.
    """
    done, left = None, written(able, "able")
    while not left.isEmpty():
        first = lambda key: F.min("_at").over(Window.partitionBy(key))
        now = written(left.withColumn("_d", first("document_id")).withColumn("_k", first("_key")).where("_at = _d and _at = _k").select(*able.columns), "started")
        done = now if done is None else done.unionByName(now)
        left = written(left.join(now.select("document_id"), "document_id", "left_anti").join(now.select("_key"), "_key", "left_anti").select(*able.columns), "waiting")
    return able.where("false") if done is None else done


def start_jobs(documents: DataFrame, jobs: DataFrame, requests: DataFrame, kind: str, sources: tuple[str, ...], state: str, now: Column, refused: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, new jobs, documents) of requests (document_id, idempotency_key[, requested_at][, target_index_version and other columns]).

    There is an outcome for each pair of document and key; of repeats of a pair that with the least other columns counts. Outcomes are as if the pairs were gone through by
    requested_at (none: last), document and key. A known key gives its document's job again and changes nothing, and is an IDEMPOTENCY_CONFLICT for other documents.
    A document must exist (NOT_FOUND), must not be refused, and be in one of the source states (INVALID_STATE); then the request starts a job, the key is the document's from
    then on, and the document goes to `state`, in which its later requests find it. A request that is refused makes no job, so its key stays free. refused: why a request
    is refused, or null, over its columns and the document's as doc_size and doc_checksum. Job ids are name-based on kind and key, so a repeated run gives the same.
    """
    pair = ["document_id", "idempotency_key"]
    extra = [c for c in requests.columns if c not in pair]
    asked = requests.groupBy(*pair).agg(F.min(F.struct(*extra)).alias("_least")).select(*pair, *(F.col(f"_least.{c}") for c in extra)) if extra else requests.select(*pair).distinct()
    moment = F.col("requested_at") if "requested_at" in extra else F.lit(None).cast("timestamp")
    known = jobs.where(F.col("kind") == kind).select("idempotency_key", F.col("id").alias("_job"), F.col("document_id").alias("_of"))
    about = documents.select(F.col("id").alias("document_id"), F.col("status").alias("_status"), *(F.col(c).alias(f"doc_{c}") for c in ("size", "checksum") if c in documents.columns))
    joined = asked.join(known, "idempotency_key", "left").join(about, "document_id", "left")
    reason = F.when(F.col("_status").isNull(), "NOT_FOUND")
    if refused is not None:
        reason = F.coalesce(reason, refused)
    reason = F.coalesce(reason, F.when(~F.col("_status").isin(*sources), "INVALID_STATE"))
    place = F.struct(moment.isNull().alias("late"), moment.alias("moment"), "document_id", "idempotency_key")
    own_key = F.coalesce("idempotency_key", F.concat(F.lit("\0"), "document_id"))  # no key is nobody else's
    judged = written(joined.withColumn("_reason", reason).withColumn("_at", place), "judged")
    started = written(_started(judged.where("_job is null and _reason is null").select("document_id", own_key.alias("_key"), "_at")), "matched")
    owners = started.select("_key", F.col("document_id").alias("_owner"), F.col("_at").alias("_since"))
    told = judged.withColumn("_key", own_key).join(owners, "_key", "left")
    outcome = F.when(F.col("_job").isNotNull(), F.when(F.col("_of") == F.col("document_id"), "known").otherwise("IDEMPOTENCY_CONFLICT")).when(F.col("_owner") == F.col("document_id"), "started").when(F.col("_since") < F.col("_at"), "IDEMPOTENCY_CONFLICT").otherwise(F.coalesce("_reason", F.lit("INVALID_STATE")))
    own = identity.uuid5(F.concat_ws(":", F.lit(kind), "_key"))
    told = written(told.withColumn("outcome", outcome).withColumn("job_id", F.when(F.col("outcome") == "known", F.col("_job")).when(F.col("outcome") == "started", own)), "outcomes")
    started = told.where("outcome = 'started'")
    target = F.col("target_index_version") if "target_index_version" in requests.columns else F.lit(None).cast("int")
    rows = started.select(
        F.col("job_id").alias("id"), F.lit(kind).alias("kind"), "document_id", F.lit("QUEUED").alias("status"), F.lit(None).cast("string").alias("stage"), F.lit(0).alias("progress"), F.lit(0).alias("attempt"), "idempotency_key",
        F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("timestamp").alias("lease_expires_at"), F.lit(None).cast("timestamp").alias("heartbeat_at"), F.lit(False).alias("cancel_requested"), now.alias("available_at"),
        F.lit(None).cast("int").alias("source_index_version"), target.cast("int").alias("target_index_version"), now.alias("created_at"),
    )
    changed = documents.join(started.select(F.col("document_id").alias("id"), F.lit(True).alias("_hit")).distinct(), "id", "left")
    status = F.when(F.col("_hit"), state).otherwise(F.col("status"))
    count = F.when(F.col("_hit"), F.col("row_version") + 1).otherwise(F.col("row_version"))
    after = changed.withColumn("status", status).withColumn("row_version", count).select(*documents.columns)
    return told.select("document_id", "idempotency_key", "job_id", "outcome"), rows, after


def start_ingestion(documents: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column, objects: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As start_jobs. objects: (document_id, object_size) of what was uploaded; one that is missing or has another size than declared is refused, and so is a checksum
    that isn't the document's. A document without one takes over the request's."""
    asked, refused = requests, F.lit(None).cast("string")
    if objects is not None:
        asked = asked.join(objects.select("document_id", F.col("object_size").cast("long").alias("object_size")), "document_id", "left")
        refused = F.when(F.col("object_size").isNull(), "OBJECT_MISSING").when(F.col("object_size") != F.col("doc_size"), "SIZE_MISMATCH")
    if "checksum" in requests.columns:
        refused = F.coalesce(refused, F.when(F.col("checksum") != F.col("doc_checksum"), "CHECKSUM_CONFLICT"))
    told, rows, after = start_jobs(documents, jobs, asked, "ingestion", ("UPLOADING", "UPLOADED", "FAILED"), "QUEUED", now, refused)
    if "checksum" in requests.columns and "checksum" in documents.columns:
        new = told.where("outcome = 'started'").join(asked.groupBy("document_id", "idempotency_key").agg(F.min("checksum").alias("_sum")), ["document_id", "idempotency_key"]).select(F.col("document_id").alias("id"), "_sum")
        after = after.join(new, "id", "left").withColumn("checksum", F.coalesce("checksum", "_sum")).select(*documents.columns)
    return told, rows, after


def start_deletion(documents: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From here on the documents are excluded from search."""
    return start_jobs(documents, jobs, requests, "deletion", DELETABLE, "DELETING", now)


def start_reindex(documents: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    return start_jobs(documents, jobs, requests, "reindex", REINDEXABLE, "REINDEXING", now)


def outbox(jobs: DataFrame, event_type: str, domain: str, now: Column) -> DataFrame:
    """Pending outbox rows for new jobs; the event id is name-based on the job."""
    event = F.to_json(F.struct(F.lit(1).alias("schema_version"), identity.uuid5(F.col("id")).alias("event_id"), F.lit(event_type).alias("event_type"), identity.rfc3339(now).alias("occurred_at"), F.lit(domain).alias("domain"), "document_id", F.col("id").alias("job_id"), F.lit(0).alias("attempt")))
    return jobs.select(identity.uuid5(F.col("id")).alias("event_id"), F.lit(event_type).alias("event_type"), event.alias("payload"), F.lit("PENDING").alias("status"), now.alias("available_at"))


def job_status(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The projection that status queries return; unknown ids have error NOT_FOUND."""
    wanted = ids.select("id").distinct().join(jobs.select("id", "kind", "document_id", "status", "stage", "progress", "attempt"), "id", "left")
    return wanted.withColumn("error", F.when(F.col("status").isNull(), "NOT_FOUND"))


def finish(documents: DataFrame, jobs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) after done (job_id[, chunk_count, index_version]): ingestion and reindex end in READY, deletion in DELETED."""
    extra = [c for c in ("chunk_count", "index_version") if c in done.columns]
    closing = done.select(F.col("job_id").alias("id"), *(F.col(c).alias(f"_{c}") for c in extra), F.lit(True).alias("_done"))
    ended = jobs.join(closing, "id", "left")
    of = ended.where("_done").select(F.col("document_id").alias("id"), F.when(F.col("kind") == "deletion", "DELETED").otherwise("READY").alias("_to"), *(f"_{c}" for c in extra)).dropDuplicates(["id"])
    joined = documents.join(of, "id", "left")
    after = joined.withColumn("status", F.coalesce("_to", "status")).withColumn("row_version", F.when(F.col("_to").isNotNull(), F.col("row_version") + 1).otherwise(F.col("row_version")))
    for c in extra:
        after = after.withColumn(c, F.coalesce(f"_{c}", c))
    ended = ended.withColumn("status", F.when(F.col("_done"), "COMPLETED").otherwise(F.col("status"))).withColumn("stage", F.when(F.col("_done"), "FINALIZING").otherwise(F.col("stage"))).withColumn("progress", F.when(F.col("_done"), 100).otherwise(F.col("progress")))
    return after.select(*documents.columns), ended.select(*jobs.columns)


def fail(documents: DataFrame, jobs: DataFrame, failed: DataFrame, now: Column, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) after failed (job_id, stage, error_code, error_message, retryable): waiting for a retry, or given up."""
    hit = jobs.join(failed.select(F.col("job_id").alias("id"), F.col("stage").alias("_stage"), "error_code", "error_message", "retryable"), "id", "left")
    routed = control.after_failure(hit, most).withColumn("route", F.when(F.col("retryable").isNotNull(), F.col("route")))
    status, document = control.after_job_failure(F.col("kind"), F.col("route"))
    marked = routed.withColumn("_new", F.when(F.col("route").isNotNull(), status)).withColumn("_doc", F.when(F.col("route").isNotNull(), document))
    delay = F.make_interval(secs=control.backoff(F.col("next_attempt")))
    after_jobs = marked.withColumn("status", F.coalesce("_new", "status")).withColumn("attempt", F.when(F.col("route").isNotNull(), F.col("next_attempt")).otherwise(F.col("attempt"))).withColumn("stage", F.coalesce("_stage", "stage")).withColumn("available_at", F.when(F.col("route") == "retry", now + delay).otherwise(F.col("available_at")))
    gone = marked.where("_doc is not null").select(F.col("document_id").alias("id"), "_doc", F.col("error_code").alias("_code"), F.col("error_message").alias("_message")).dropDuplicates(["id"])
    after = documents.join(gone, "id", "left").withColumn("status", F.coalesce("_doc", "status")).withColumn("row_version", F.when(F.col("_doc").isNotNull(), F.col("row_version") + 1).otherwise(F.col("row_version")))
    for c in ("code", "message"):
        if f"error_{c}" in documents.columns:
            after = after.withColumn(f"error_{c}", F.coalesce(f"_{c}", f"error_{c}"))
    return after.select(*documents.columns), after_jobs.select(*jobs.columns)


# --- index configs ---


def activate(configs: DataFrame, version: int) -> DataFrame:
    """configs with one active version. A version that isn't there is an error."""
    if configs.where(F.col("version") == version).isEmpty():
        raise ValueError(f"no index config of version {version}")
    return configs.withColumn("active", F.col("version") == version)


def active_config(configs: DataFrame) -> dict:
    """The active config; there must be just one."""
    rows = configs.where("active").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} active index configs")
    return rows[0].asDict()


def provision(configs: DataFrame, wanted: dict) -> DataFrame:
    """configs with the wanted one as the first and active config where there is none; a drift of the active one is an error."""
    if wanted["chunk_overlap_tokens"] >= wanted["chunk_size_tokens"] or wanted["dense_dimension"] <= 0 or wanted["chunk_size_tokens"] <= 0:
        raise ValueError("impossible index config")
    if configs.isEmpty():
        row = {c: wanted.get(c) for c in configs.columns} | {"active": True}
        return configs.sparkSession.createDataFrame([tuple(row[c] for c in configs.columns)], configs.schema)
    now = active_config(configs)
    drift = [c for c in ("dense_model", "dense_dimension", "sparse_model") if now.get(c) != wanted.get(c)]
    if drift:
        raise ValueError(f"the active index config differs in {', '.join(drift)}")
    return configs


def invalid_documents(documents: DataFrame) -> DataFrame:
    """Rows that break the tables' rules, with the rule."""
    from corvane.schemas import DOCUMENT_STATES

    rule = F.when(~(F.col("size") > 0), "size").when(~F.col("status").isin(*DOCUMENT_STATES), "status").when(F.col("id").isNull(), "id")
    return documents.withColumn("rule", rule).where("rule is not null")
