"""Inputs and expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.workspace import Workspace, at_most_rows  # noqa: F401


#: Rows of whole texts that Python gets at a time: an Arrow batch is held by JVM and Python, and memory that large ones took is kept.
BATCH = 512


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z alone; other letters stay, so positions and lengths do too."""
    plain = F.octet_length(text) == F.length(text)  # no other letters: lower() goes by bytes, translate() looks up every character
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def buckets(rows: int, per_bucket: int = 4096, most: int = 65536) -> int:
    """How many hash buckets keep about per_bucket rows each; their count is bounded, not their rows."""
    return max(1, min(most, rows // per_bucket))


#: Groups of at least this part of all rows are joined by broadcast: there can be no more of them than this.
MANY = 16384


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with groups, one row a key, whose `count` says how many of the rows have that key.

    Keys with more than one in MANY rows, so fewer than MANY of them, come by broadcast and stay where
    they lie; only the others are shuffled by key. rows and groups must be stored tables, as they are read twice.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.broadcast(groups.filter(F.col(count) > total // MANY + 1).drop(count))
    cold = groups.filter(F.col(count) <= total // MANY + 1).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
