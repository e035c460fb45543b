"""Ids, keys, checksums and times as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip

#: Fixed value: the namespace of point ids.
POINT_NAMESPACE = "6f1d0c9e-3f4a-5b6c-8d7e-0a1b2c3d4e5f"
#: Fixed value: where the chunk numbers of table facts begin.
FACT_BASE = 1_000_000


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """The name-based UUID of version 5, from SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def point_id(document: Column, document_version: Column, index_version: Column, chunk: Column) -> Column:
    return uuid5(F.concat_ws(":", document.cast("string"), document_version.cast("string"), index_version.cast("string"), chunk.cast("string")))


def table_id(document: Column, document_version: Column, index_version: Column, table: Column) -> Column:
    return F.concat_ws(":", document.cast("string"), document_version.cast("string"), index_version.cast("string"), F.concat(F.lit("t"), table.cast("string")))


def sanitize_filename(name: Column) -> Column:
    """The last path part with unsafe runs as underscores, at most 200 characters, "file" if nothing is left."""
    base = F.replace(strip(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)), F.lit(".."), F.lit("_"))
    safe = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.left(F.when(safe == "", F.lit("file")).otherwise(safe), F.lit(200))


def original_key(document: Column, filename: Column) -> Column:
    return F.concat(F.lit("documents/"), document.cast("string"), F.lit("/original/"), sanitize_filename(filename))


def markdown_key(document: Column) -> Column:
    return F.concat(F.lit("documents/"), document.cast("string"), F.lit("/parsed/document.md"))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def rfc3339(moment: Column) -> Column:
    """UTC text with Z; microseconds only where there are any. The session's zone must be UTC."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def scoped_to_domain(name: str, domain: str) -> bool:
    """Whether a bucket, index or namespace name holds the domain as a part set off by marks."""
    import re

    return bool(domain) and domain in [p for p in re.split(r"[^A-Za-z0-9]+", name)] or bool(re.search(rf"(?<![A-Za-z0-9]){re.escape(domain)}(?![A-Za-z0-9])", name))
