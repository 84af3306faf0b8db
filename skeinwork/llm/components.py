"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.shared import cut


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (a, b) is connected to.

    Self loops and null ends are dropped; repeated edges count once; no edges give no rows. The number of rounds is
    logarithmic in the longest path; every round is a written table.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = _print(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)), "edges")
        after = _print(edges)
        if after == before:
            break
        before = after
    least = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    roots = roots.join(least.select(F.col("a").alias("node")), "node", "left_anti")
    return least.withColumnRenamed("a", "node").unionByName(roots)
