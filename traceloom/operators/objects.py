"""Object graphs of many items at once: marked from their roots, swept, renumbered, references rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.workspace import Workspace

#: An item with more objects in use than this is refused.
MOST_OBJECTS = 50_000


def mark(objects: DataFrame, references: DataFrame, roots: DataFrame, most: int = MOST_OBJECTS) -> tuple[DataFrame, DataFrame]:
    """What the roots reach, and which items are refused: (item, node, depth) and (item, reason).

    objects (item, node), references (item, src, dst), roots (item, node); further columns are not read, rows that
    repeat count once, and rows with a null item or node take no part. Breadth first, all items in the same rounds:
    a round follows the references of the last frontier to what was not seen, and is stored (references to objects that
    exist are stored once before, a row for each object), so the number of rounds is the depth of the deepest item,
    whatever the number of items. Items above
    `most` stop at the round in which they exceed it ("too many objects"); those without a root that exists are
    refused too ("no root").
    """
    ws = Workspace(objects.sparkSession)
    objects = ws.save(objects.select("item", "node").dropna().distinct())
    edges = references.select("item", "src", F.col("dst").alias("node")).dropna().join(objects, ["item", "node"], "left_semi")
    links = ws.save(edges.groupBy("item", "src").agg(F.collect_set("node").alias("nodes")))  # no longer than the object that holds them
    asked = ws.save(roots.select("item", "node").filter("item IS NOT NULL").distinct())
    frontier = ws.save(asked.join(objects, ["item", "node"], "left_semi").withColumn("depth", F.lit(0)))
    seen, counts, depth = frontier, frontier.groupBy("item").count(), 0
    over = ws.save(counts.filter(F.col("count") > most).select("item"))
    while not frontier.isEmpty():
        depth += 1
        going = frontier.select("item", F.col("node").alias("src")).join(over, "item", "left_anti")
        met = links.join(going, ["item", "src"]).select("item", F.explode("nodes").alias("node")).distinct()
        frontier = ws.save(met.join(seen, ["item", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
        if not depth % 8:
            seen = ws.save(seen)
        over = ws.save(seen.groupBy("item").count().filter(F.col("count") > most).select("item"))
    reached = seen.join(over, "item", "left_anti")
    rootless = asked.select("item").distinct().join(seen.select("item").distinct(), "item", "left_anti")
    refused = over.withColumn("reason", F.lit("too many objects")).union(rootless.withColumn("reason", F.lit("no root")))
    return reached, refused


def sweep(reached: DataFrame) -> DataFrame:
    """mark's objects with new numbers from 1 within each item, by their old numbers. An item has at most mark's `most` rows, so its window is bounded."""
    return reached.withColumn("new_number", F.row_number().over(Window.partitionBy("item").orderBy("node")))


def rewrite_references(references: DataFrame, numbered: DataFrame) -> DataFrame:
    """references' rows of kept objects, with src_number and dst_number, the new numbers; one to nothing that is kept is null (dangling)."""
    return _numbered_targets(references.join(_numbers(numbered, "src"), ["item", "src"]), numbered)


def _numbers(numbered: DataFrame, end: str) -> DataFrame:
    return numbered.select("item", F.col("node").alias(end), F.col("new_number").alias(f"{end}_number"))


def _numbered_targets(references: DataFrame, numbered: DataFrame) -> DataFrame:
    return references.join(_numbers(numbered, "dst"), ["item", "dst"], "left")


def rebuild(objects: DataFrame, references: DataFrame, roots: DataFrame, most: int = MOST_OBJECTS) -> DataFrame:
    """item, node, new_number, depth, targets, reason: a row for each object that stays, and one for each refused item.

    targets are the new numbers of the object's references by `position`, null for dangling ones. A refused item's
    row has only the reason. references need a column `position`, which orders those of one object.
    """
    ws = Workspace(objects.sparkSession)
    reached, refused = mark(objects, references, roots, most)
    numbered = ws.save(sweep(reached))
    # an object's references are part of the object; they are gathered as they stand in it
    rewritten = _numbered_targets(references.select("item", "src", "dst", "position"), numbered)  # those of objects that go meet nothing below
    targets = rewritten.groupBy("item", F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("position", "dst_number"))).alias("t"))
    kept = numbered.join(targets, ["item", "node"], "left")
    numbers = F.coalesce(F.col("t.dst_number"), F.array().cast("array<int>"))
    kept = kept.select("item", "node", "new_number", "depth", numbers.alias("targets"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(refused.select("item", "reason"), allowMissingColumns=True)
