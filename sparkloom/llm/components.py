"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, of one orderable type): the smallest node reachable.

    Every round hooks nodes to the smallest neighbour they know and writes the edges to the shared folder; rounds grow
    with the logarithm of the longest chain. A node of any degree is only ever reduced to its minimum.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: neighbours above a node hook to the smallest node around it
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        # small star: neighbours below a node, and the node, hook to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n")).select(F.greatest("b", "m").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
