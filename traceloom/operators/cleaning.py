"""Cleaning of files of any format: each goes to the cleaner of its format, the others say why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.workspace import Workspace

from .containers import clean_images, image_segments
from .detect import MAX_BYTES, detect_format, error_code
from .markup import clean_markdown
from .svg import clean_svg


def _images(items: DataFrame) -> DataFrame:
    rows = clean_images(image_segments(items), keep_orientation=True)
    return rows.select("item_id", "cleaned", F.when(F.col("cleaned").isNull(), "corrupt").alias("reason"))


def _svg(items: DataFrame) -> DataFrame:
    return clean_svg(items).select("item_id", F.encode("cleaned", "UTF-8").alias("cleaned"), "reason")


def _markdown(items: DataFrame) -> DataFrame:
    texts = items.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
    return clean_markdown(texts, "item_id", "text").select("item_id", F.encode("cleaned", "UTF-8").alias("cleaned"), F.when(F.col("cleaned").isNull(), "not utf-8").alias("reason"))


#: What cleans a format; a format without an entry is not cleaned.
CLEANERS = {("jpeg", "png", "webp"): _images, ("svg",): _svg, ("markdown",): _markdown}


def clean_files(items: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """item_id, format, cleaned (bytes, null if not cleaned), reason (why not: an error code, or what the cleaner says; else null).

    Each format is filtered and cleaned as a plan of its own. Null contents are unknown. A row for each row, whatever its id.
    """
    rows = items.select(F.monotonically_increasing_id().alias("item_id"), F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    rows = rows.withColumn("format", F.coalesce(detect_format(F.col("content")), F.lit("unknown")))
    rows = Workspace(items.sparkSession).save(rows)  # read once for each format; the stored number tells rows apart
    known = [f for formats in CLEANERS for f in formats]
    fits = F.col("format").isin(*known) & (F.octet_length("content") <= MAX_BYTES)
    code = F.coalesce(error_code(F.coalesce(F.octet_length("content"), F.lit(0)), F.col("format"), known), F.lit("unsupported-format"))
    out = rows.filter(~fits | F.col("content").isNull()).select("item_id", "id", "format", F.lit(None).cast("binary").alias("cleaned"), code.alias("reason"))
    for formats, cleaner in CLEANERS.items():
        part = rows.filter(fits & F.col("format").isin(*formats))
        done = cleaner(part.select("item_id", "content"))
        out = out.unionByName(part.select("item_id", "id", "format").join(done, "item_id"))
    return out.drop("item_id").select(F.col("id").alias("item_id"), "format", "cleaned", "reason")
