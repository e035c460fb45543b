"""Objects under a root folder of any store that Hadoop reaches: put, delete, buckets, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.parsers import heads, objects


class ObjectStore:
    """Buckets are folders under the root; keys are paths within them. Bulk reading goes through Spark, single writes through its file system."""

    def __init__(self, spark: SparkSession, root: str, bucket: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{bucket}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, key: str):
        return self._path(f"{self.base}/{key}")

    def ensure_bucket(self) -> None:
        self._fs.mkdirs(self._path(self.base))

    def put(self, key: str, data: bytes) -> None:
        """Write an object; an old one of the key is replaced by a move, so that no reader sees half of it."""
        import uuid

        draft = self._at(f"{key}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(data))
        out.close()
        self._fs.delete(self._at(key), False)
        if not self._fs.rename(draft, self._at(key)):
            raise OSError(f"can't move an object to {key}")

    def head(self, key: str) -> dict | None:
        """Size and change time, or None where there is no such object."""
        if not self._fs.exists(self._at(key)):
            return None
        s = self._fs.getFileStatus(self._at(key))
        return {"size": s.getLen(), "modified": s.getModificationTime()}

    def exists(self, key: str) -> bool:
        return self.head(key) is not None

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise FileNotFoundError(key)
        return bytes(objects(self.spark, f"{self.base}/{key}").first()["content"])

    def delete(self, key: str) -> None:
        """Delete an object; a missing one does no harm."""
        self._fs.delete(self._at(key), True)

    def listing(self) -> DataFrame:
        """(key, size) of all objects, without reading them."""
        root = self._fs.makeQualified(self._path(self.base)).toString().rstrip("/")
        found = heads(self.spark, self.base)
        return found.select(F.regexp_replace("path", f"^(?:file:/*|[^:]+://[^/]*/)", "/").alias("_p"), F.col("length").alias("size")).select(F.expr(f"substring(_p, length('{_local(root)}') + 2)").alias("key"), "size").where("key not like '%.tmp'")


def _local(root: str) -> str:
    import re

    return re.sub(r"^(?:file:/*|[^:]+://[^/]*/)", "/", root)
