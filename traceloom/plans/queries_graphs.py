"""The registered queries over object graphs, revisions, boxes and digests of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom.workspace import Workspace

from ..operators import boxes, objects, revisions
from . import made
from .queries import table

#: Orders of a customer above which its graph is refused: few, so that some are.
MOST_ORDERS = 12


def object_graphs(spark, sf_dir):
    """Each customer's orders as objects, lineitems as references to other orders of the customer, some to none; the first order is the root."""
    each = Window.partitionBy("item")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("node"))
    ws = Workspace(spark)  # rounds and rewriting read both tables again
    orders = ws.save(orders.select("item", "node", (F.row_number().over(each.orderBy("node")) - 1).alias("place"), F.count("*").over(each).alias("n")))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("node"))
    to = (F.col("place") + 1 + F.col("l_partkey") % 7) % (F.col("n") + 1)
    lines = lines.select("item", F.col("node").alias("src"), F.col("l_linenumber").alias("position"), to.alias("place"))
    references = lines.join(orders.select("item", "place", F.col("node").alias("dst")), ["item", "place"], "left").withColumn("dst", F.coalesce("dst", F.lit(-1).cast("long")))
    references = ws.save(references.select("item", "src", "dst", "position"))
    out = objects.rebuild(orders, references, orders.filter("place = 0"), most=MOST_ORDERS)
    shown = F.array_join(F.transform("targets", lambda t: F.coalesce(t.cast("string"), F.lit("null"))), ",")
    return out.select("item", "node", F.col("new_number").cast("long").alias("new_number"), F.col("depth").cast("long").alias("depth"), shown.alias("targets"), "reason")


def revised_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", made.revised(F.col("doc_id")).alias("content"))


def revision_chains(spark, sf_dir):
    chains, state = revisions.revision_chains(revised_files(spark, sf_dir), "doc_id", "content")
    entries = revisions.revision_entries(chains)
    seen = revisions.visible_entries(entries).select("item", "object", "revision", F.lit(True).alias("visible"))
    rows = entries.drop("id").join(seen, ["item", "object", "revision"], "left")
    out = state.join(rows, "item", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("revisions").cast("long").alias("revisions"), "state", F.col("revision").cast("long").alias("revision"), "object", "offset", F.coalesce("visible", F.lit(False)).alias("visible"))


def box_trees(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", made.boxed(F.col("doc_id")).alias("content"))
    return boxes.box_trees(files, "doc_id").withColumnRenamed("item_id", "doc_id").withColumn("depth", F.col("depth").cast("long"))


QUERIES = {f.__name__: f for f in (object_graphs, revision_chains, box_trees)}
