"""Totals over sets of keys, and distinct counts that can be added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers; its counts are within 1.04 / 2^(LG / 2) of the truth, as a standard error (1.6 % at 12).
LG = 12


def rolled_up(rows: DataFrame, keys: list[str], *totals: Column) -> DataFrame:
    """keys, level and totals for all keys, for all but the last, and so on to the total of all; an empty table has no rows.

    level is grouping_id: the sum of 1 for the last key, 2 for the one before... of the keys that are summed over, which
    tells a summed key from a null one.
    """
    return rows.rollup(*keys).agg(F.grouping_id().alias("level"), *totals)


def cubed(rows: DataFrame, keys: list[str], *totals: Column) -> DataFrame:
    """The same for every set of the keys."""
    return rows.cube(*keys).agg(F.grouping_id().alias("level"), *totals)


def distinct_sketches(rows: DataFrame, by: list[str], value: str, lg: int = LG) -> DataFrame:
    """by and sketch (binary, at most 2^lg bytes): stored, they stand for the distinct values of their rows; nulls don't count."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, lg).alias("sketch"))


def merged_counts(sketches: DataFrame, by: list[Column | str]) -> DataFrame:
    """by and the estimated number of distinct values of all sketches together; values that several share count once."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
