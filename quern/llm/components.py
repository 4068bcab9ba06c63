"""Connected components of a table of links, without gathering links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import dropped, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long); root is the smallest node reachable.

    Alternates two steps on the links until nothing changes: each node passes its smallest
    neighbour to its larger neighbours, then to its smaller ones. Both are an aggregation with
    partial sums and an equi-join, so a node with very many links is never gathered in one row; the
    number of rounds grows with the logarithm of the longest chain. Each round is a written table.
    Nulls and links from a node to itself are dropped: they connect nothing.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = held = written(links, "links")
    before = None
    while True:
        # Larger neighbours of each node move to its smallest neighbour, or to itself.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Smaller neighbours of each node, and the node, move to its smallest neighbour.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        links = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        links = written(links, "links")
        dropped(held)
        held = links
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())
        before = now
