"""EXIF: a small walker lists a TIFF block's entries, expressions read them."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import until_nul, unsigned
from ..functions.slices import by_row

ENTRIES = T.ArrayType(T.StructType([T.StructField("ifd", T.StringType()), T.StructField("tag", T.IntegerType()), T.StructField("type", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("little", T.BooleanType())]))
# Bytes of the TIFF types, and tags of texts by field, in the main and the Exif directory.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
ROOT_TEXTS = {"description": 0x010E, "make": 0x010F, "model": 0x0110, "software": 0x0131, "date_time": 0x0132, "artist": 0x013B, "host_computer": 0x013C, "copyright": 0x8298}
EXIF_TEXTS = {"date_original": 0x9003, "camera_owner": 0xA430, "lens_model": 0xA434}
ORIENTATION, EXIF_IFD, GPS_IFD, MAKER_NOTE = 0x0112, 0x8769, 0x8825, 0x927C
ORIENTATIONS = {1: "Normal", 2: "Mirrored horizontally", 3: "Rotated 180°", 4: "Mirrored vertically", 5: "Mirrored and rotated 90° CCW", 6: "Rotated 90° CW", 7: "Mirrored and rotated 90° CW", 8: "Rotated 90° CCW"}
#: Main directories followed in a chain.
CHAIN = 8


def directory(data: bytes, order: str, at: int, name: str):
    """Entries of the directory at an offset that lie within the block, and the offset of the next one."""
    if at <= 0 or at + 2 > len(data):
        return [], 0
    found = []
    count = min(struct.unpack_from(order + "H", data, at)[0], (len(data) - at - 2) // 12)
    for place in range(at + 2, at + 2 + 12 * count, 12):
        tag, kind, number = struct.unpack_from(order + "HHI", data, place)
        size = TYPE_BYTES.get(kind, 0) * number
        start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if kind in TYPE_BYTES and start + size <= len(data):
            found.append({"ifd": name, "tag": tag, "type": kind, "count": number, "data": data[start : start + size], "little": order == "<"})
    after = at + 2 + 12 * count
    return found, struct.unpack_from(order + "I", data, after)[0] if after + 4 <= len(data) else 0


def block_entries(data: bytes | None):
    """All entries of a TIFF block: the chain of main directories, then the last Exif and GPS directories that they name; None if it is none."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4])) if data is not None and len(data) >= 8 else None
    if order is None:
        return None
    found, seen, at = [], set(), struct.unpack_from(order + "I", data, 4)[0]
    while at > 0 and at not in seen and len(seen) < CHAIN:
        seen.add(at)
        more, at = directory(data, order, at, "main")
        found += more
    for name, tag in (("exif", EXIF_IFD), ("gps", GPS_IFD)):
        pointers = [e for e in found if e["ifd"] == "main" and e["tag"] == tag]
        if pointers and pointers[-1]["type"] in (3, 4) and pointers[-1]["count"]:
            last = pointers[-1]
            (at,) = struct.unpack_from(order + ("H" if last["type"] == 3 else "I"), last["data"])
            found += directory(data, order, at, name)[0]
    return found


tiff_entries = by_row(ENTRIES)(block_entries)


def _last(entries: Column, ifd: str, tag: int) -> Column:
    found = F.filter(entries, lambda e: (e["ifd"] == ifd) & (e["tag"] == tag))
    return F.get(found, F.size(found) - 1)


def _text(e: Column) -> Column:
    return F.nullif(until_nul(e["data"]), F.lit(""))


def _short(e: Column) -> Column:
    return F.when((e["count"] >= 1) & (e["type"] == 3), unsigned(e["data"], 0, 2, e["little"])).when((e["count"] >= 1) & (e["type"] == 4), unsigned(e["data"], 0, 4, e["little"]))


def _rational(e: Column, k: int) -> Column:
    over, under = (unsigned(e["data"], 8 * k + at, 4, e["little"]) for at in (0, 4))
    return F.when(under == 0, 0.0).otherwise(over / under)


def _degrees(e: Column) -> Column:
    return F.when((e["type"] == 5) & (e["count"] >= 3), _rational(e, 0) + _rational(e, 1) / 60 + _rational(e, 2) / 3600)


def with_exif(items: DataFrame, tiff_col: str, name: str = "exif") -> DataFrame:
    """items with a struct of the block's texts, orientation, maker_note, tag_count, lat, lon, altitude; null if it is no TIFF block.

    Of tags that come twice, the last counts. Signs follow the references of the GPS directory.
    """
    rows = items.withColumn("_entries", tiff_entries.asNondeterministic()(tiff_col))
    entry = lambda ifd, tag: _last(F.col("_entries"), ifd, tag)
    rows = rows.withColumns({f"_g{k}": entry("gps", k) for k in range(1, 7)})
    signed = lambda k, letter: _degrees(F.col(f"_g{k + 1}")) * F.when(F.upper(_text(F.col(f"_g{k}"))).startswith(letter), -1).otherwise(1)
    height = F.when((F.col("_g6.type") == 5) & (F.col("_g6.count") >= 1), _rational(F.col("_g6"), 0))
    below = F.coalesce(_short(F.col("_g5")) == 1, F.lit(False))
    rows = rows.withColumns({"_lat": signed(1, "S"), "_lon": signed(3, "W"), "_alt": F.when(below, -height).otherwise(height)})
    both = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    note = entry("exif", MAKER_NOTE)
    record = F.struct(
        *[_text(entry("main", tag)).alias(f) for f, tag in ROOT_TEXTS.items()],
        *[_text(entry("exif", tag)).alias(f) for f, tag in EXIF_TEXTS.items()],
        _short(entry("main", ORIENTATION)).alias("orientation"),
        F.coalesce(F.octet_length(note["data"]) > 0, F.lit(False)).alias("maker_note"),
        F.size("_entries").alias("tag_count"),
        *[F.when(both, F.col(f"_{x}")).alias(x) for x in ("lat", "lon")],
        F.when(both, F.col("_alt")).alias("altitude"),
    )
    return rows.withColumn(name, F.when(F.col("_entries").isNotNull(), record)).drop("_entries", *[f"_g{k}" for k in range(1, 7)], "_lat", "_lon", "_alt")


def turned(orientation: Column) -> Column:
    """Whether a viewer must turn or mirror the image."""
    return F.coalesce(orientation.between(2, 8), F.lit(False))


def orientation_label(orientation: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ORIENTATIONS.items() for x in kv]), orientation.cast("int"))


def orientation_block(orientation: Column) -> Column:
    """A little-endian TIFF block of 26 bytes that holds the orientation alone."""
    value = F.unhex(F.lpad(F.hex(orientation.cast("long")), 2, "0"))
    return F.concat(F.unhex(F.lit("49492A00" "08000000" "0100" "12010300" "01000000")), value, F.unhex(F.lit("000000" "00000000")))


def show_position(lat: Column, lon: Column) -> Column:
    one = lambda v, pos, neg: F.format_string("%.5f° %s", F.abs(v), F.when(v >= 0, pos).otherwise(neg))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(", ", one(lat, "N", "S"), one(lon, "E", "W")))
