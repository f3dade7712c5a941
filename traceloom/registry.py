"""Name of a query: its callable (spark, sf_dir), and DuckDB SQL for the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.oracles import ORACLES as TABLE_ORACLES
from .plans.oracles_files import ORACLES as FILE_ORACLES
from .plans.oracles_graphs import ORACLES as GRAPH_ORACLES
from .plans.oracles_scans import ORACLES as SCAN_ORACLES
from .plans.queries import QUERIES as TABLE_QUERIES
from .plans.queries import hidden_scan
from .plans.queries_files import QUERIES as FILE_QUERIES
from .plans.queries_graphs import QUERIES as GRAPH_QUERIES
from .plans.queries_scans import QUERIES as SCAN_QUERIES

QUERIES, ORACLES = TABLE_QUERIES | FILE_QUERIES | GRAPH_QUERIES | SCAN_QUERIES, TABLE_ORACLES | FILE_ORACLES | GRAPH_ORACLES | SCAN_ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden characters by language and category."""
    return hidden_scan(spark, sf_dir)
