"""Whole numbers, text and CBOR strings within binary columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(data: Column, at) -> Column:
    """The byte at a position from 0, as a long; null beyond the end."""
    return F.conv(F.nullif(F.hex(F.substring(data, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(1))), F.lit("")), 16, 10).cast("long")


def unsigned(data: Column, at, size: int, little: Column | bool = False) -> Column:
    """An unsigned whole number of `size` bytes; little tells the byte order, by row if it is a column."""
    parts = [byte(data, at + k) for k in range(size)]
    big, small = (sum((p * F.lit(1 << 8 * k) for k, p in enumerate(order)), F.lit(0).cast("long")) for order in (parts[::-1], parts))
    return F.when(little, small).otherwise(big) if isinstance(little, Column) else small if little else big


def latin(data: Column) -> Column:
    """One character for each byte."""
    return F.decode(data, "ISO-8859-1")


def lossy(data: Column) -> Column:
    """UTF-8 text, with replacement characters where the bytes are not."""
    return F.make_valid_utf8(data.cast("string"))


def until_nul(data: Column) -> Column:
    return F.trim(F.element_at(F.split(latin(data), "\\x00"), 1))


def cbor_text(text: Column, most: int = 4096) -> Column:
    """The CBOR text string at the start of Latin-1 text (one character a byte); null if there is none of at most `most` bytes."""
    at = lambda k: F.ascii(F.substring(text, k + 1, 1))
    head = at(0) - 0x60  # major type 3
    size = F.when(head.between(0, 23), head).when(head == 24, at(1)).when(head == 25, at(1) * 256 + at(2)).when(head == 26, ((at(1).cast("long") * 256 + at(2)) * 256 + at(3)) * 256 + at(4))
    start = F.when(head < 24, 1).when(head == 24, 2).when(head == 25, 3).otherwise(5)
    return F.when((size <= most) & (F.length(text) >= start + size), F.substring(text, start + 1, size.cast("int")))


def cbor_after(text: Column, key: str) -> Column:
    """The first non-blank CBOR text that directly follows an occurrence of the key; null if none does."""
    parts = F.split(text, key)
    # texts behind each occurrence, 4101 characters of them: the next parts belong to it as well
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(-len(key))) + F.length(p) + len(key))))
    values = F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: cbor_text(F.substring(text, e + len(key) + 1, F.lit(4101))))
    return F.get(F.filter(values, lambda v: F.coalesce(F.trim(v) != "", F.lit(False))), F.lit(0))
