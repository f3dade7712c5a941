"""Values joined to the ranges that hold them, by a key that both sides share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_ranges(points: DataFrame, ranges: DataFrame, value: str, start: str = "start", stop: str = "stop", width: int = 256, how: str = "inner") -> DataFrame:
    """points with the columns of each range (start to stop, both included) that holds their `value`, a whole number.

    A range is listed once for each bucket of `width` values that it touches, and a point has one bucket, so this is
    an equality join with a further condition: Spark broadcasts the ranges if they are small and shuffles by bucket,
    splitting full ones, if not. Choose `width` about as long as the ranges are. A null value, or a range with a null
    end or its ends reversed, matches nothing; ranges that overlap give a row each. how: inner or left.
    """
    touched = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
    listed = ranges.filter(F.col(start) <= F.col(stop)).withColumn("_bucket", F.explode(touched)).withColumnsRenamed({start: "_start", stop: "_stop"})
    dealt = points.withColumn("_at", F.floor(F.col(value) / width))
    held = (F.col("_at") == F.col("_bucket")) & (F.col(value) >= F.col("_start")) & (F.col(value) <= F.col("_stop"))
    return dealt.join(listed, held, how).drop("_at", "_bucket", "_start", "_stop")
