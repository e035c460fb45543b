"""Reading objects: bytes to markdown by content type, events from JSON, gold cases."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import strip
from corvane.schemas import EVENT, EVENT_TYPES
from corvane.sources.office import document_markdown, sheet_markdown

#: Content types and what reads them.
PARSERS = {
    "text/plain": "text", "text/markdown": "text", "text/x-markdown": "text", "text/csv": "text",
    "application/pdf": "layout", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "layout", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "sheet",
}


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files under a path, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def heads(spark: SparkSession, path: str) -> DataFrame:
    """The same without the bytes, which aren't read."""
    return objects(spark, path).select("path", "modificationTime", "length")


def existing(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    return wanted.join(listed.select("path"), "path", "left_semi")


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where that fails, stripped. Empty texts become null: they are an error."""
    text = strip(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")))
    return F.when(text != "", text)


def layout_markdown(data: bytes) -> str:
    """PDF and presentations as markdown. Needs docling."""
    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    return DocumentConverter().convert(DocumentStream(name="document", stream=io.BytesIO(data))).document.export_to_markdown()


def parse(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files (.., content, content_type) with markdown and error (UNSUPPORTED_FILE, EMPTY_DOCUMENT, PARSER_MISSING, PARSE_FAILED or null).

    Texts are decoded by Spark; other kinds go through readers, in Python, and only their rows do.
    """
    readers = {"sheet": sheet_markdown, "document": document_markdown, "layout": layout_markdown} | (readers or {})
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in PARSERS.items() for x in pair)), F.col("content_type"))
    typed = files.withColumn("_kind", kind)
    plain = typed.where("_kind is null or _kind = 'text'").withColumn("markdown", F.when(F.col("_kind") == "text", decode_text(F.col("content"))))
    plain = plain.withColumn("error", F.when(F.col("_kind").isNull(), "UNSUPPORTED_FILE").when(F.col("markdown").isNull(), "EMPTY_DOCUMENT"))
    rest = typed.where("_kind in ('sheet', 'document', 'layout')")
    schema = plain.schema

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for data, k in zip(frame["content"], frame["_kind"], strict=True):
                try:
                    text = readers[k](bytes(data)).strip()
                    texts.append(text or None)
                    errors.append(None if text else "EMPTY_DOCUMENT")
                except ModuleNotFoundError:
                    texts.append(None)
                    errors.append("PARSER_MISSING")
                except Exception:  # whatever a reader makes of a broken file is that row's error
                    texts.append(None)
                    errors.append("PARSE_FAILED")
            yield frame.assign(markdown=texts, error=errors)

    return plain.unionByName(rest.mapInPandas(read, schema)).drop("_kind")


def parse_events(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Typed events of JSON lines, with error where one isn't an event of a known type, and the columns to keep."""
    parsed = lines.withColumn("event", F.from_json(column, EVENT))
    bad = F.when(F.col("event").isNull() | F.col("event.event_type").isNull(), "INVALID_EVENT").when(~F.col("event.event_type").isin(*EVENT_TYPES), "UNKNOWN_EVENT").when(F.col("event.document_id").isNull(), "INVALID_EVENT")
    return parsed.select("event.*", bad.alias("error"), *keep)


def gold(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(corpus (fixture, filename), cases (query_id, query, needles, note)) of a gold file's JSON."""
    data = json.loads(text)
    corpus = spark.createDataFrame([(c["fixture"], c["filename"]) for c in data["corpus"]], "fixture string, filename string")
    cases = spark.createDataFrame([(c["id"], c["query"], c["must_contain"], c.get("note", "")) for c in data["cases"]], "query_id string, query string, needles array<string>, note string")
    return corpus, cases
