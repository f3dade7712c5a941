"""The 31-polynomial digest of bytes, chunk by chunk in any order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE, MODULUS = 31, 1 << 32
#: Bytes of a chunk.
CHUNK = 1 << 16


@F.pandas_udf(T.LongType())
def _digest(data: pd.Series) -> pd.Series:
    """h = 31 h + byte modulo 2^32 from 0, as a product with the powers of 31, which wrap at 32 bits as the digest does."""
    longest = int(data.map(lambda d: len(d) if d is not None else 0).max() or 0)
    powers = np.cumprod(np.full(longest + 1, BASE, np.uint32), dtype=np.uint32)
    powers = np.concatenate([np.ones(1, np.uint32), powers])

    def one(d: bytes | None) -> int | None:
        if d is None:
            return None
        return int(np.dot(np.frombuffer(d, np.uint8).astype(np.uint32), powers[: len(d)][::-1]))

    return data.map(one).astype("Int64")


def power(n: Column) -> Column:
    """31^n modulo 2^32, by the bits of n."""
    squares = [pow(BASE, 1 << k, MODULUS) for k in range(40)]
    step = lambda p, s: F.when(F.call_function("shiftright", n, s["k"]).bitwiseAND(F.lit(1).cast("long")) == 1, _times(p, s["v"])).otherwise(p)
    bits = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("long").alias("v")) for k, v in enumerate(squares)])
    return F.aggregate(bits, F.lit(1).cast("long"), step)


def _times(a: Column, b: Column) -> Column:
    """a b modulo 2^32 within 64 bits: the upper half of a counts only by its lower 16 bits."""
    high, low = F.shiftright(a, 16).bitwiseAND(0xFFFF), a.bitwiseAND(0xFFFF)
    return F.pmod(F.pmod(high * b, F.lit(1 << 16)) * (1 << 16) + low * b, F.lit(MODULUS))


def chunks(items: DataFrame, id_col: str, content_col: str, size: int = CHUNK) -> DataFrame:
    """id, offset, data, total: the bytes of each row's content in pieces; an empty content is one empty piece, a null one has no row."""
    content, total = F.col(content_col), F.octet_length(content_col).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = items.filter(content.isNotNull()).select(id_col, content_col, total.alias("total"), F.explode(starts).alias("offset"))
    return rows.select(id_col, "offset", F.substring(content, (F.col("offset") + 1).cast("int"), F.lit(size)).alias("data"), "total")


def digest_of_chunks(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, digest, length: of pieces (offset, data, total) of the same item, in any order and however cut, the digest of the whole.

    A piece counts by its own digest times 31 to the power of the bytes after it, so the whole is a sum: Spark adds up
    within tasks first, and neither an item's bytes nor its pieces ever stand in one task.
    """
    after = F.col("total") - F.col("offset") - F.octet_length("data")
    part = _times(_digest("data"), power(after))
    return pieces.select(*by, part.alias("part"), F.octet_length("data").cast("long").alias("size")).groupBy(*by).agg(F.pmod(F.sum("part"), F.lit(MODULUS)).alias("digest"), F.sum("size").alias("length"))


def digest(content: Column) -> Column:
    """The digest of a binary column, within its row."""
    return _digest(content)
