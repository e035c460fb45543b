"""Connected components of a link table, by alternating large and small stars.

Labels are node numbers; a component is named by its smallest node. Every round is written to the
shared scratch folder, so lineage stays short and nothing of the graph comes to the driver but two numbers a round.
Minima are aggregated before the shuffle. A node with very many links still meets its minimum by a join on the node, in as many tasks as adaptive execution splits it into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that occurs in links (a, b). Self-links and repeats do no harm; null ends are passed over."""
    edges = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    seen = _digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = large.join(low, F.col("a") == F.col("k"))
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        edges = written(small, "edges")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
