"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) of all nodes but the smallest of each component; edges: a, b.

    Each half step links a node's neighbours to the smallest among them, which a partial
    minimum finds; a node with very many neighbours is a skewed join that adaptive
    execution splits. Each round is written below ``folder``, so lineage stays short.
    """
    ordered = edges.where("a <> b AND a IS NOT NULL AND b IS NOT NULL")
    now = written(ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/round-0")
    seen, i = None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, i = mark, i + 1
        # Large star: every larger neighbour of a node goes to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, f"{folder}/round-{i}-large")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{folder}/round-{i}")
