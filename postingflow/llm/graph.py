"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.session import settle


def _sum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest one: those above a node (large) or up to it (small)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    # Settled: Spark splits a hot node's partition only where both sides are plain tables.
    lowest = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
    met = both.join(lowest, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the least node.

    Large-star and small-star steps in turn: the number of rounds grows with the logarithm
    of the number of nodes, and a node with very many links is aggregated before the
    shuffle and split by Spark in the join with its settled minimum. Each round is written to the shared folder, so a
    lost executor repeats a round at most.
    """
    edges = settle(edges.where("a <> b").distinct(), "edges")
    before = _sum(edges)
    while True:
        edges = settle(_star(settle(_star(edges, large=True), "large"), large=False), "small")
        now = _sum(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
