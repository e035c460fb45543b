"""Index versions as partitions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.scratch import folder


def cutover_counts(rows: DataFrame, source: int = 1, target: int = 2) -> DataFrame:
    """Write rows under two versions, check that no document of the old is missing in the new, and count the new by source.

    The old partition is passed over by partition pruning and never read.
    """
    spark = rows.sparkSession
    path = folder(spark, "versions")
    both = rows.select("doc_id", "chunk_index", "source").withColumn("index_version", F.explode(F.array(F.lit(source), F.lit(target))))
    both.write.partitionBy("index_version").parquet(path)
    stored = spark.read.parquet(path)
    old, new = (stored.where(F.col("index_version") == v).select("doc_id").distinct() for v in (source, target))
    if not old.join(new, "doc_id", "left_anti").isEmpty():
        raise ValueError("documents of the active version are missing in the target")
    return stored.where(F.col("index_version") == target).groupBy(F.col("index_version").cast("int").alias("index_version"), "source").agg(F.count("*").alias("n"))
