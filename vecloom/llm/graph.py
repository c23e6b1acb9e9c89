"""Connected components of a link table, by alternating stars; no node's links are ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``); the component is its smallest node.

    Large star: a node hands the smallest of its neighbourhood to its larger neighbours. Small star: it hands its smallest
    neighbour to the other smaller ones. The rounds end when only stars are left, after about log(nodes)^2 rounds at worst.
    Minima are partial aggregates and the joins may split a hot node's rows. Links of a node to itself or to null are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        edges, n = _held(edges)
        if _all_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if n <= ONE_TASK else both
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, _ = _held(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(least.withColumnRenamed("m", "b"))
        edges = (edges.coalesce(1) if n <= ONE_TASK else edges).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


#: links that one task may hold; so few aren't worth a shuffle
ONE_TASK = 500_000


def _held(links: DataFrame) -> tuple[DataFrame, int]:
    """The links written and counted; in one partition if they are few, so that what follows needs no shuffle."""
    links = materialize(links, "links")
    n = links.count()
    return (links.coalesce(1) if n <= ONE_TASK else links), n


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller one at most, and that one has none: then it is the component's smallest."""
    ends = edges.groupBy("a").agg(F.count("*").alias("n"))
    return ends.filter("n > 1").isEmpty() and edges.select("b").join(ends.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
