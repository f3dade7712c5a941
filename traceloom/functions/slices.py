"""Functions of values in Python over Arrow columns, whose memory follows a slice, not a batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows, and about how many bytes, that are Python's objects at a time; a batch has up to 10,000 rows.
ROWS, BYTES = 256, 1 << 20


def in_slices(f: Callable, columns: tuple[pa.Array, ...], kind: pa.DataType) -> pa.Array:
    """f of each row; the rows of a slice are turned into Python's values and back before the next ones are."""
    n = len(columns[0])
    step = max(1, min(ROWS, BYTES * n // (1 + sum(c.nbytes for c in columns))))
    parts = [pa.array([f(*row) for row in zip(*(c.slice(at, step).to_pylist() for c in columns))], kind) for at in range(0, n, step)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def by_row(kind: DataType):
    """Makes a Spark function of a function of one row's values (bytes, str, lists, dicts; null is None)."""

    def wrap(f: Callable):
        def run(*columns: pa.Array) -> pa.Array:
            return in_slices(f, columns, to_arrow_type(kind))

        run.__name__ = f.__name__
        return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)

    return wrap
