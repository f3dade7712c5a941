"""Connected components as rounds of Spark joins (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) rows: links every v to the smallest of u and its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): node and component, the smallest node reachable, for every node that has an edge.

    The smallest neighbour of a node is found by partial aggregation, and comes back by a join whose
    large side Spark can split, so a node with very many edges is no bottleneck. Every round is a
    stored table; the number of rounds grows with the logarithm of the number of nodes.
    """
    ws = Workspace(edges.sparkSession)
    links = ws.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(large.filter("u <> v").distinct())
        small = _star(large)
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = ws.save(down.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = mark(new)
        ws.drop(large)
        if after == before:
            break
        ws.drop(links)
        links, before = new, after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
