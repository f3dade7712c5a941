"""Scan facts before and after a cleaning, compared: what is reported as removed is a join's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hidden import CHANGED, clean_hidden
from ..plans.dims import signals


def status(found: Column) -> Column:
    return F.when(found, "detected").otherwise("not_detected")


#: Signals that a choice of blocks can spare.
SPARED = ("exif", "iptc", "xmp", "c2pa", "embedded-text")


def outcome(signal: Column, before: Column, after: Column, removable: Column, blocks: list[str] | None = None, kept_orientation: Column | None = None) -> Column:
    """In this order: what nothing can verify stays unverifiable; what wasn't there is absent; what is gone is removed;
    a kept orientation, a signal that can't be removed and one outside the chosen blocks are kept; anything else remains.
    """
    oriented = F.lit(False) if kept_orientation is None else kept_orientation & (signal == "exif")
    spared = F.lit(False) if blocks is None else signal.isin(*SPARED) & ~signal.isin(*blocks)
    return (
        F.when((before == "unable_to_verify") | (after == "unable_to_verify"), "unverifiable").when(before != "detected", "absent")
        .when(after == "not_detected", "removed").when(oriented, "kept").when(~F.coalesce(removable, F.lit(True)), "kept").when(spared, "kept").otherwise("remaining")
    )


def compare(before: DataFrame, after: DataFrame, blocks: list[str] | None = None, kept_orientation: Column | None = None) -> DataFrame:
    """before, after (item_id, signal_id, status): item_id, signal_id, before_status, after_status, outcome.

    A row for each row of `before`, whatever its ids: a null id meets the null ids after, and of several rows after
    with one id and signal the worst counts (unable_to_verify, then detected). A signal missing after is 'unknown'.
    Files that share an id can't be told apart in facts: give them ids of their own first, as clean_and_verify does.
    """
    spec = F.broadcast(signals(before.sparkSession).select("signal_id", "remove"))
    worst = F.max(F.struct((F.col("status") == "unable_to_verify").alias("u"), (F.col("status") == "detected").alias("d"), "status"))["status"]
    after = after.groupBy(F.col("item_id").alias("_item"), F.col("signal_id").alias("_signal")).agg(worst.alias("after_status"))
    met = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("signal_id") == F.col("_signal"))
    joined = before.withColumnRenamed("status", "before_status").join(after, met, "left").join(spec, "signal_id", "left")
    now = F.coalesce("after_status", F.lit("unknown"))
    told = outcome(F.col("signal_id"), F.col("before_status"), now, F.col("remove"), blocks, kept_orientation)
    return joined.select("item_id", "signal_id", "before_status", now.alias("after_status"), told.alias("outcome"))


def hidden_status(text: Column) -> Column:
    """Whether a text has a hidden character that a cleaning would take out; a null text has none."""
    return status(F.coalesce(text.rlike(CHANGED), F.lit(False)))


def text_facts(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Scan facts of texts: hidden characters, and the text watermarks that nothing can verify."""
    facts = F.array(F.struct(F.lit("hidden-unicode").alias("signal_id"), hidden_status(F.col(text_col)).alias("status")), F.struct(F.lit("claude-watermark").alias("signal_id"), F.lit("unable_to_verify").alias("status")))
    return items.select(F.col(id_col).alias("item_id"), F.explode(facts).alias("f")).select("item_id", "f.*")


def clean_and_verify(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Clean texts, scan the cleaned texts again, compare: item_id, signal_id, before_status, after_status, outcome.

    A row before and after is one row, so nothing is joined or shuffled and ids may repeat or be null. A null text is clean.
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_before"), clean_hidden(F.col(text_col)).alias("_after"))
    fact = lambda signal, before, after: F.struct(F.lit(signal).alias("signal_id"), before.alias("before_status"), after.alias("after_status"))
    unable = F.lit("unable_to_verify")
    facts = F.array(fact("hidden-unicode", hidden_status(F.col("_before")), hidden_status(F.col("_after"))), fact("claude-watermark", unable, unable))
    rows = rows.select("item_id", F.explode(facts).alias("f")).select("item_id", "f.*")
    return rows.withColumn("outcome", outcome(F.col("signal_id"), F.col("before_status"), F.col("after_status"), F.lit(True)))


def exposure(facts: DataFrame) -> DataFrame:
    """facts (item_id, signal_id, status) by axis: detected, unverifiable, total, void (nothing found, something unverifiable)."""
    joined = facts.join(F.broadcast(signals(facts.sparkSession).select("signal_id", "axis")), "signal_id", "left")
    counts = joined.groupBy("item_id", F.coalesce("axis", F.lit("privacy")).alias("axis")).agg(F.count_if(F.col("status") == "detected").alias("detected"), F.count_if(F.col("status") == "unable_to_verify").alias("unverifiable"), F.count("*").alias("total"))
    return counts.withColumn("void", (F.col("detected") == 0) & (F.col("unverifiable") > 0))
