"""Streaming forms of the text scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hidden import clean_hidden, hidden_counts


def flagged_per_window(texts: DataFrame, ts: str, text: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, texts, flagged: texts and those with removable hidden characters in each window; later rows than `late` are dropped by the watermark."""
    removable = hidden_counts(F.col(text))["removable"]
    counted = texts.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("texts"), F.count_if(removable > 0).alias("flagged"))
    return counted.select(F.col("window.start").alias("start"), "texts", "flagged")


def cleaned(texts: DataFrame, text: str) -> DataFrame:
    """The rows with hidden characters taken out of `text`; stateless, for streams and tables alike."""
    return texts.withColumn(text, clean_hidden(F.col(text)))
