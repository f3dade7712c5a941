"""Files as rows: a size gate that the scan applies before it reads contents, formats and error codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import MAX_BYTES, detect_format, error_code
from ..plans.dims import FORMATS


#: Characters of a pasted text that are scanned.
PASTED = 500_000
PDF, MARKDOWN = "*.[pP][dD][fF]", "*.{md,mdx}"


def pasted(texts: DataFrame, text_col: str, most: int = PASTED) -> DataFrame:
    """texts, each cut after `most` characters, as the form for pasted text does, with truncated."""
    return texts.withColumn("truncated", F.length(text_col) > most).withColumn(text_col, F.substring(text_col, 1, most))


def read_files(spark: SparkSession, path: str, glob: str = "*", most: int = MAX_BYTES, depth: int | None = None, dotted: bool = True) -> DataFrame:
    """path, name, length, content of all files below path whose names match glob and that hold 1 to `most` bytes.

    The filters on length reach the scan, so larger files are never read. `depth` limits the folders
    between path and file, dotted=False leaves out files and folders whose names begin with a dot.
    Files that vanish or can't be read are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    files = reader.load(path)
    below = F.substring_index(F.col("path"), path.rstrip("/") + "/", -1)
    if depth is not None:
        files = files.filter(F.regexp_count(below, F.lit("/")) <= depth)
    if not dotted:
        files = files.filter(~below.rlike(r"(?:\A|/)\."))
    return files.filter((F.col("length") > 0) & (F.col("length") <= most)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def with_format(files: DataFrame) -> DataFrame:
    """files with format and error_code; a bad file is a row, not a failure."""
    return files.withColumn("format", detect_format(F.col("content"))).withColumn("error_code", error_code(F.col("length"), F.col("format"), [f[0] for f in FORMATS]))


def write_report(report: DataFrame, path: str) -> None:
    """An audit report as JSON lines, one file: it holds counts alone, a few rows a section."""
    report.coalesce(1).write.mode("overwrite").json(path)
