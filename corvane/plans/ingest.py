"""Ingestion, deletion and reindexing: from markdown to points of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.encoders import dense_encoder
from corvane.functions.identity import checksum, point_id, table_id
from corvane.operators import lexical, structure
from corvane.operators.membership import split
from corvane.schemas import POINT
from corvane.sources.index import PointIndex
from corvane.sources.providers import Provider, with_values
from corvane.sources.scratch import written


def points(documents: DataFrame, config: dict, now: Column | None = None, dense: Provider | None = None) -> DataFrame:
    """Points of documents (document_id, filename, content_type, document_version, markdown[, page_offsets]) under an index config row.

    Units come from the structure plans; dense vectors from the provider or the built-in encoder, lexical weights from stems by hashed place, counted in the unit's own row.
    A document for some of whose units the provider fails has no points at all: ingest() tells its error.
    """
    built = encoded_units(documents, config, now, dense)
    if dense is not None:
        built = built.join(built.where("dense is null").select("document_id").distinct(), "document_id", "left_anti")
    return built.select(*(F.col(f.name).cast(f.dataType) for f in POINT))


def encoded_units(documents: DataFrame, config: dict, now: Column | None = None, dense: Provider | None = None) -> DataFrame:
    """All units as points, with dense_error where the provider failed."""
    pages = "page_offsets" if "page_offsets" in documents.columns else None
    cut = structure.units(documents, config["chunk_size_tokens"], config["chunk_overlap_tokens"], "document_id", "markdown", pages)
    rows = cut.join(documents.select("document_id", "filename", "content_type", "document_version"), "document_id").withColumn("index_version", F.lit(config["version"]))
    rows = rows.withColumn("id", point_id(F.col("document_id"), F.col("document_version"), F.col("index_version"), F.col("chunk_index")))
    rows = rows.withColumn("_embed", X.embed_text(F.col("text"), F.array("filename"), F.col("section_path"))).withColumn("sparse", lexical.vector(F.col("_embed")))
    if dense is None:
        rows = rows.withColumn("dense", dense_encoder(config["dense_dimension"])("_embed")).withColumn("dense_error", F.lit(None).cast("string"))
    else:
        rows = with_values(written(rows, "units"), "_embed", dense, "dense")
    return rows.withColumn("created_at", F.current_timestamp() if now is None else now).withColumn("table_id", F.when(F.col("table_index").isNotNull(), table_id(F.col("document_id"), F.col("document_version"), F.col("index_version"), F.col("table_index"))))


def ingest(index: PointIndex, documents: DataFrame, config: dict, known: DataFrame | None = None, dense: Provider | None = None) -> DataFrame:
    """Upsert the points of documents and return their control rows: document_id, checksum, chunk_count, status, error.

    known: control rows (document_id, checksum, status, chunk_count) from before. A document that is READY with this very content and has points in the version
    is a DUPLICATE: nothing is parsed, encoded or written for it. Texts without content are EMPTY_MARKDOWN; a document that the provider fails for has its
    error; one whose points aren't all there after the write is MISSING_POINTS. All of these have failed; the others are READY.
    """
    version = config["version"]
    index.ensure(version, config["dense_dimension"])
    given = written(documents.withColumn("checksum", checksum(F.col("markdown").cast("binary"))), "given")
    if known is None:
        known = given.where("false").select("document_id", "checksum", F.lit("").alias("status"), F.lit(0).cast("long").alias("chunk_count"))
    pair = F.concat_ws(":", F.col("document_id").cast("string"), "checksum").alias("_pair")
    ready = written(known.where("status = 'READY'").select(pair, F.col("chunk_count").alias("_had")), "ready")
    there = index.placed(version).select("document_id").distinct()
    same, fresh = split(given.withColumn("_pair", pair), ready, "_pair")
    same = written(same.join(there, "document_id", "left_semi"), "same")
    good = written(given.where(F.coalesce(X.strip(F.col("markdown")) != "", F.lit(False))).join(same.select("document_id"), "document_id", "left_anti"), "good")
    units = written(encoded_units(good.drop("checksum"), config, None, dense), "encoded")
    failed = written(units.where("dense is null").groupBy("document_id").agg(F.min("dense_error").alias("_failed")), "failed")
    whole = units.join(failed, "document_id", "left_anti").select(*(F.col(f.name).cast(f.dataType) for f in POINT))
    index.upsert(whole)
    stored = index.placed(version).select("id").withColumn("_in", F.lit(True))
    counted = whole.join(stored, "id", "left").groupBy("document_id").agg(F.count("*").alias("_n"), F.count("_in").alias("_found"))
    rows = given.select("document_id", "checksum").join(same.select("document_id", "_pair"), "document_id", "left").join(ready.dropDuplicates(["_pair"]), "_pair", "left").join(failed, "document_id", "left").join(counted, "document_id", "left")
    rows = rows.join(good.select("document_id", F.lit(True).alias("_good")), "document_id", "left")
    error = F.when(F.col("_pair").isNotNull(), None).when(F.col("_good").isNull(), "EMPTY_MARKDOWN").when(F.col("_failed").isNotNull(), F.col("_failed")).when(F.col("_n").isNull(), "NO_CHUNKS").when(F.col("_found") < F.col("_n"), "MISSING_POINTS")
    status = F.when(F.col("_pair").isNotNull(), "DUPLICATE").when(error.isNull(), "READY").otherwise("FAILED")
    count = F.when(F.col("_pair").isNotNull(), F.col("_had")).when(error.isNull(), F.col("_n"))
    return rows.select("document_id", "checksum", F.coalesce(count, F.lit(0)).alias("chunk_count"), status.alias("status"), error.alias("error"))


def reindex(index: PointIndex, documents: DataFrame, config: dict) -> dict:
    """Write all documents under a target config and cut over; if that fails, what the target had before is in it again and the old version stays."""
    before = index.state()
    try:
        index.upsert(points(documents, config))
        return index.cutover(config["version"])
    except Exception:
        index.restore(before)
        raise


def delete(index: PointIndex, documents: DataFrame) -> bool:
    """Delete all versions of documents (document_id); True when none of their points is left."""
    index.delete_documents(documents)
    return index.points().join(documents.select("document_id"), "document_id", "left_semi").isEmpty()
