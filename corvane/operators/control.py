"""Control-plane predicates, lookups and state changes over document, job and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import strip
from corvane.schemas import EXCLUDED_STATES, REACHED_FROM


def find(table: DataFrame, *, status: Column | None = None, name: str | None = None, query: str | None = None, filename: str = "filename", newest: tuple[Column, ...], limit: int | None = 20) -> DataFrame:
    """Rows of a status whose name holds both texts in any case, newest first. Wildcards in them are plain letters."""
    found = table if status is None else table.where(status)
    for part in (name, query):
        if part:
            found = found.where(F.lower(filename).contains(part.lower()))
    found = found.orderBy(*newest)
    return found if limit is None else found.limit(limit)


def stale(table: DataFrame, state: Column, moment: str, cutoff: Column) -> DataFrame:
    """Rows in a state whose moment is set and lies before the cutoff."""
    return table.where(state & F.col(moment).isNotNull() & (F.col(moment) < cutoff))


def without(table: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't excluded; a null key is never excluded."""
    return table.join(excluded.select(key).distinct(), key, "left_anti")


def excluded_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status").isin(*EXCLUDED_STATES)).select("id")


def search_filter(points: DataFrame, *, index_version: int, ids: DataFrame | None = None, document_version: int | None = None, created_from=None, created_to=None, excluded: DataFrame | None = None) -> DataFrame:
    """Points of one index version that pass all filters given. The version is the partition column, so others aren't read."""
    found = points.where(F.col("index_version") == index_version)
    if document_version is not None:
        found = found.where(F.col("document_version") == document_version)
    if created_from is not None:
        found = found.where(F.col("created_at") >= F.lit(created_from))
    if created_to is not None:
        found = found.where(F.col("created_at") <= F.lit(created_to))
    if ids is not None:
        found = found.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    return found if excluded is None else without(found, excluded, "document_id")


def first_copies(table: DataFrame, checksum: Column, id: str) -> DataFrame:
    """(checksum, id of the first row, copies) for each content."""
    return table.select(checksum.alias("checksum"), id).groupBy("checksum").agg(F.min(id).alias(id), F.count("*").alias("copies"))


def newest_each(table: DataFrame, key: str, order: tuple[Column, ...]) -> DataFrame:
    """The first row of each key in an order."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def unseen(events: DataFrame, inbox: DataFrame, keys: tuple[str, ...] = ("consumer", "event_id")) -> DataFrame:
    """Events that the inbox doesn't hold, each once."""
    return events.dropDuplicates(list(keys)).join(inbox.select(*keys), list(keys), "left_anti")


def backoff(attempt: Column, schedule: tuple[int, ...] = (0, 1, 3, 10, 30), jitter: float = 0.0) -> Column:
    """Seconds before an attempt: the schedule's entry, its last one beyond it, and a fixed share of the jitter."""
    at = F.least(attempt, F.lit(len(schedule) - 1)).cast("int")
    return F.element_at(F.array(*(F.lit(float(s)) for s in schedule)), at + 1) + F.lit(float(jitter)) * (attempt % 3) / 2.0


def after_failure(failed: DataFrame, most: int = 5) -> DataFrame:
    """failed (attempt, retryable) with next_attempt and route: retry while attempts are left, else dead letter."""
    following = failed.withColumn("next_attempt", F.col("attempt") + 1)
    return following.withColumn("route", F.when(F.col("retryable") & (F.col("next_attempt") < most), "retry").otherwise("dead_letter"))


def pending(outbox: DataFrame, now: Column, limit: int | None = 50) -> DataFrame:
    """Outbox rows that are due, oldest first."""
    due = outbox.where((F.col("status") == "PENDING") & (F.col("available_at") <= now)).orderBy("available_at", "event_id")
    return due if limit is None else due.limit(limit)


def allowed(current: Column, to: Column) -> Column:
    """Whether a document may change from one state to another."""
    pairs = [f"{a}>{b}" for b, sources in REACHED_FROM.items() for a in sources]
    return F.concat_ws(">", current, to).isin(*pairs)


def transition(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """documents after wanted changes (id, to): legal ones take effect and count up row_version; illegal marks the others."""
    joined = documents.join(wanted.select("id", F.col("to").alias("_to")), "id", "left")
    legal = F.col("_to").isNotNull() & allowed(F.col("status"), F.col("_to"))
    return joined.select(*(c for c in documents.columns if c not in ("status", "row_version")), F.when(legal, F.col("_to")).otherwise(F.col("status")).alias("status"), F.when(legal, F.col("row_version") + 1).otherwise(F.col("row_version")).alias("row_version"), (F.col("_to").isNotNull() & ~legal).alias("illegal"))


def lease(jobs: DataFrame, owner: str, now: Column, seconds: int) -> DataFrame:
    """jobs with lease: passthrough for ended ones, refused where another's lease is live, else taken (owner, expiry, heartbeat)."""
    ended = F.col("status").isin("COMPLETED", "CANCELLED")
    live = F.coalesce(F.col("lease_expires_at") > now, F.lit(False)) & ~F.col("lease_owner").eqNullSafe(F.lit(owner))
    kind = F.when(ended, "passthrough").when(live, "refused").otherwise("taken")
    took = F.col("lease") == "taken"
    until = now + F.make_interval(secs=F.lit(seconds))
    return jobs.withColumn("lease", kind).withColumn("lease_owner", F.when(took, F.lit(owner)).otherwise(F.col("lease_owner"))).withColumn("lease_expires_at", F.when(took, until).otherwise(F.col("lease_expires_at"))).withColumn("heartbeat_at", F.when(took, now).otherwise(F.col("heartbeat_at")))


def heartbeat(jobs: DataFrame, owner: str, now: Column, seconds: int) -> DataFrame:
    """jobs with the owner's leases extended."""
    mine = F.col("lease_owner") == owner
    return jobs.withColumn("lease_expires_at", F.when(mine, now + F.make_interval(secs=F.lit(seconds))).otherwise(F.col("lease_expires_at"))).withColumn("heartbeat_at", F.when(mine, now).otherwise(F.col("heartbeat_at")))


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs of every kind after a recovery run: expired leases go back to the queue, cancelled ones end."""
    expired = (F.col("status") == "PROCESSING") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") < now)
    status = F.when(expired & F.coalesce(F.col("cancel_requested"), F.lit(False)), "CANCELLED").when(expired, "QUEUED").otherwise(F.col("status"))
    return jobs.withColumn("recovered", expired).withColumn("status", status).withColumn("lease_owner", F.when(expired, F.lit(None).cast("string")).otherwise(F.col("lease_owner"))).withColumn("lease_expires_at", F.when(expired, F.lit(None).cast("timestamp")).otherwise(F.col("lease_expires_at")))


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """jobs with the flag set on live ones of the ids (id)."""
    wanted = jobs.join(ids.select("id", F.lit(True).alias("_c")).distinct(), "id", "left")
    live = ~F.col("status").isin("COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER")
    return wanted.withColumn("cancel_requested", F.coalesce(F.col("_c") & live, F.lit(False)) | F.coalesce(F.col("cancel_requested"), F.lit(False))).drop("_c")


def after_job_failure(kind: Column, route: Column) -> tuple[Column, Column]:
    """(job status, document status) after a failure, by the kind of job: a failed reindex leaves the old version live."""
    job = F.when(route == "retry", "RETRY_WAIT").otherwise("DEAD_LETTER")
    document = F.when(route == "retry", F.lit(None)).when(kind == "deletion", "DELETE_FAILED").when(kind == "reindex", "READY").otherwise("FAILED")
    return job, document


def upload_error(size: Column, content_type: Column, types: tuple[str, ...], most: int = 50 << 20) -> Column:
    """Why an upload is refused, or null."""
    return F.when(~(size > 0), "EMPTY").when(size > most, "FILE_TOO_LARGE").when(~content_type.isin(*types), "UNSUPPORTED_FILE")


def request_error(query: Column, limit: Column, candidates: Column) -> Column:
    """Why a search request is refused, or null: query of 1 to 4000 characters, limit 1 to 50, candidates 1 to 200 and no fewer."""
    return F.when(query.isNull() | (strip(query) == ""), "EMPTY_QUERY").when(F.length(query) > 4000, "QUERY_TOO_LONG").when((limit < 1) | (limit > 50), "BAD_LIMIT").when((candidates < 1) | (candidates > 200) | (candidates < limit), "BAD_CANDIDATES")
