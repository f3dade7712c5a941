"""Tables between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import functools
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="traceloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that of setCheckpointDir; a temporary one only where driver and executors are one process."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_:
        return set_
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_most_rows(spark: SparkSession, rows: int) -> None:
    """From now on, Python gets at most so many rows at a time in this session: for frames that the caller writes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None):
    """Within it, Python gets at most so many rows at a time; the session's own number comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        at_most_rows(spark, rows)
    try:
        yield
    finally:
        if spark.conf.get(key) != before:
            spark.conf.set(key, before)


class Workspace:
    """Parquet tables of one operator call. They cut lineage, survive lost executors and carry true sizes.

    Results read them, so they stay until release(), which the caller calls once the results are written.
    """

    made: set[str] = set()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/traceloom/{uuid.uuid4().hex}"
        self.count = 0

    def save(self, frame: DataFrame, rows: int | None = None) -> DataFrame:
        """Write the frame and read it back. Its Python gets at most `rows` rows at a time, where that is given."""
        self.count += 1
        Workspace.made.add(self.root)
        path = f"{self.root}/{self.count}"
        with arrow_rows(self.spark, rows):
            frame.write.parquet(path)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        saved._traceloom_path = path
        return saved

    def drop(self, frame: DataFrame) -> None:
        """Delete a table that no later step reads."""
        _delete(self.spark, frame._traceloom_path)


def release(spark: SparkSession) -> int:
    """Delete the tables of all operator calls so far; their results must have been written. Returns how many calls had any."""
    done = len(Workspace.made)
    while Workspace.made:
        _delete(spark, Workspace.made.pop())
    return done
