"""Object graphs and versions: overlay, reachability, dense numbers, running offsets, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.workspace import Workspace


def overlay(entries: DataFrame, item: str, obj: str, rev: str, at_least: int = 0) -> DataFrame:
    """The entry of each object as seen at a revision: that of the smallest rev (newest is 0) from it on."""
    first = F.row_number().over(Window.partitionBy(item, obj).orderBy(rev))
    return entries.filter(F.col(rev) >= at_least).withColumn("_n", first).filter("_n = 1").drop("_n")


def reachable(spark: SparkSession, edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """node and depth (fewest steps) of all that edges(src, dst) reach from the roots, or in `most` steps.

    Breadth first: each round follows the edges of the last frontier, less the nodes seen before, as a stored table.
    """
    ws = Workspace(spark)
    edges = ws.save(edges.select("src", "dst").distinct())
    frontier = ws.save(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while (most is None or depth < most) and not frontier.isEmpty():
        depth += 1
        met = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = ws.save(met.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier) if depth % 16 else ws.save(seen.union(frontier))
    return seen


def renumber(rows: DataFrame, item: str, old: str, length: str) -> DataFrame:
    """Dense new numbers from 1 within an item, and the running offset of each row by the lengths before it."""
    order = Window.partitionBy(item).orderBy(old)
    before = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("new_number", F.row_number().over(order)).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def apply_deletions(items: DataFrame, text: str, edits: str):
    """The text without its edits, an array of (start, end): in order of start and end; one that starts before the cursor is skipped."""
    start = F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out"))

    def step(s, e):
        taken = F.struct(e["end"].alias("cursor"), F.concat(s["out"], F.substring(F.col(text), s["cursor"] + 1, e["start"] - s["cursor"])).alias("out"))
        return F.when(e["start"] < s["cursor"], s).otherwise(taken)

    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), s["cursor"] + 1, F.length(text)))
    return F.aggregate(F.array_sort(edits), start, step, rest)
