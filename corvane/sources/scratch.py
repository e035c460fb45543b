"""Scratch tables under the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset on one machine (tests), a temporary folder is made and set; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(partial(removed, spark, path))
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, if the driver's JVM still runs."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has gone; the folder is the cluster's to clean
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: written to a scratch folder and read again, so that nothing upstream is computed twice."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """df as a table, as `written`, whose rows lie in buckets by a column: what reads it by that column needs no shuffle."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    table = f"corvane_{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)
