"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is a few joins and pre-aggregated groupings on node ids; its edges are written to the shared folder, so a
lost executor costs one round. The driver sees one checksum row a round, never links or components. The number of
rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import scratch


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each node with `least`, the least of it and its neighbours. It is a written table, so that both sides of the join
    with the edges are plain shuffles, and Spark's adaptive skew join splits a node of many links."""
    least = edges.groupBy(node).agg(F.min(other).alias("least")).withColumn("least", F.least(node, "least"))
    return scratch(edges.sparkSession, least, "least")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both, "a", "b"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, "a", "b")
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every node of the links but the least of its component, with that least node. links: columns a and b, of one orderable type, a <> b."""
    spark = links.sparkSession
    edges = scratch(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges
        seen = now
        edges = scratch(spark, _small(_large(edges)), "links")
