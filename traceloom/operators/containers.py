"""Image containers (JPEG, PNG, WebP): segments as an array column, kept and dropped by Spark expressions, put together again."""

from __future__ import annotations

import struct
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slices import by_row
from .detect import detect_format
from .exif import orientation_block, turned, with_exif
from .verify import compare, status

SEGMENTS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(x, T.IntegerType()) for x in ("start", "data", "stop")], T.StructField("head", T.BinaryType())]))
#: Bytes of a segment's payload that classification looks at.
HEAD = 64
# Segments that survive a cleaning. JPEG: kinds below; PNG and WebP: chunk types (critical PNG chunks too).
JPEG_KEPT = ("jfif", "icc", "adobe", "structural")
PNG_STRIPPED = ("tEXt", "zTXt", "iTXt", "eXIf", "tIME", "caBX", "dSIG")
PNG_KEPT = ("tRNS", "gAMA", "cHRM", "sRGB", "iCCP", "sBIT", "pHYs", "bKGD", "acTL", "fcTL", "fdAT")
WEBP_KEPT = ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP")
# The signal of each kind of segment.
SIGNAL_OF = {
    "exif": "exif", "xmp": "xmp", "xmp-extension": "xmp", "iptc": "iptc", "jumbf": "c2pa", "comment": "embedded-text", "icc": "icc",
    "eXIf": "exif", "tEXt": "embedded-text", "zTXt": "embedded-text", "iTXt": "embedded-text", "iTXt-xmp": "xmp", "caBX": "c2pa", "iCCP": "icc",
    "EXIF": "exif", "XMP ": "xmp", "C2PA": "c2pa", "ICCP": "icc",
}
IMAGE_SIGNALS = ("c2pa", "exif", "xmp", "iptc", "embedded-text", "icc")


def _jpeg(data: bytes):
    """(tag, start, data, stop): markers as two hex digits; the scan, to the end of the file, is one segment."""
    at = 2
    while at + 1 < len(data) and data[at] == 0xFF:
        start = at
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 1 >= len(data):
            return
        marker = data[at + 1]
        if marker in (0xDA, 0xD9):
            yield f"{marker:02X}", start, at + 2, len(data)
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            stop = at + 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            stop = at + 2 + size
            if size < 2 or stop > len(data):
                return
        yield f"{marker:02X}", start, min(at + 4, stop), stop
        at = stop


def _png(data: bytes):
    at = 8
    while at + 12 <= len(data):
        stop = at + 12 + int.from_bytes(data[at : at + 4], "big")
        if stop > len(data):
            return
        yield data[at + 4 : at + 8].decode("latin-1"), at, at + 8, stop
        at = stop


def _webp(data: bytes):
    at = 12
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        stop = at + 8 + size
        if stop > len(data):
            return
        stop = min(stop + size % 2, len(data))
        yield data[at : at + 4].decode("latin-1"), at, at + 8, stop
        at = stop


WALKERS = {"jpeg": _jpeg, "png": _png, "webp": _webp}


@by_row(SEGMENTS)
def walk(data, kind):
    if data is None or kind not in WALKERS:
        return None
    return [{"tag": t, "start": a, "data": d, "stop": b, "head": data[d : min(b, d + HEAD)]} for t, a, d, b in WALKERS[kind](data)]


@by_row(T.BinaryType())
def put_together(data, kind, segments, more):
    """The file's signature, its kept segments and one more, if any, at its place; a PNG's end, a WebP's size and its flags of what is gone follow."""
    if segments is None:
        return None
    head = {"jpeg": 2, "png": 8, "webp": 12}[kind]
    tags = [s["tag"] for s in segments]
    parts = [data[s["start"] : s["stop"]] for s in segments]
    if kind == "webp":
        for k, part in enumerate(parts):
            if tags[k] == "VP8X" and len(part) > 8:
                parts[k] = part[:8] + bytes([part[8] & ~0x0C | 0x08 * bool(more)]) + part[9:]
        parts += [more] * bool(more)
        return b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WEBP" + b"".join(parts)
    if kind == "png" and "IEND" not in tags:
        parts.append(b"\0\0\0\0IEND\xae\x42\x60\x82")
    if more:  # after JFIF, or after the header
        first = {"jpeg": "E0", "png": "IHDR"}[kind]
        parts.insert(1 if tags[:1] == [first] else 0, more)
    return data[:head] + b"".join(parts)


def once(udf):
    """Declared so that no plan repeats the function for each use of its column."""
    return udf.asNondeterministic()


def segment_kind(format_: Column, tag: Column, head: Column) -> Column:
    """JPEG: jfif, exif, xmp, xmp-extension, icc, jumbf, iptc, adobe, comment, app-unknown or structural; else the chunk's type."""
    starts = lambda text: F.startswith(F.hex(head), F.lit(text.encode().hex().upper()))
    jpeg = (
        F.when(tag == "E0", "jfif").when((tag == "E1") & starts("Exif"), "exif").when((tag == "E1") & starts("http://ns.adobe.com/xmp/extension/"), "xmp-extension")
        .when((tag == "E1") & starts("http://ns.adobe.com/xap/1.0/"), "xmp").when((tag == "E2") & starts("ICC_PROFILE"), "icc").when(tag == "EB", "jumbf")
        .when(tag == "ED", "iptc").when((tag == "EE") & starts("Adobe"), "adobe").when(tag == "FE", "comment").when(tag.between("E0", "EF"), "app-unknown").otherwise("structural")
    )
    return F.when(format_ == "jpeg", jpeg).when((tag == "iTXt") & starts("XML:com.adobe.xmp"), "iTXt-xmp").otherwise(tag)


def keeps(format_: Column, kind: Column) -> Column:
    """Whether a cleaning keeps a segment; unknown optional ones go."""
    png = ~kind.isin(*PNG_STRIPPED, "iTXt-xmp") & (kind.rlike("^[A-Z]") | kind.isin(*PNG_KEPT))
    return F.when(format_ == "jpeg", kind.isin(*JPEG_KEPT)).when(format_ == "png", png).otherwise(kind.isin(*WEBP_KEPT))


def image_segments(items: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """item_id, content, format, segments (tag, start, data, stop, kind, keep), valid. Files of other formats have null segments.

    valid: the image data is there (a JPEG scan, PNG IHDR and IDAT, WebP VP8 or VP8L).
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.col(content_col).alias("content")).withColumn("format", detect_format(F.col("content")))
    rows = rows.withColumn("walked", once(walk)("content", "format"))
    kinds = F.transform("walked", lambda s: F.struct(*[s[x].alias(x) for x in ("tag", "start", "data", "stop")], segment_kind(F.col("format"), s["tag"], s["head"]).alias("kind")))
    rows = rows.withColumn("kinds", kinds).drop("walked")
    segments = F.transform("kinds", lambda s: F.struct(*[s[x].alias(x) for x in ("tag", "start", "data", "stop", "kind")], keeps(F.col("format"), s["kind"]).alias("keep")))
    rows = rows.withColumn("segments", segments).drop("kinds")
    has = lambda *tags: reduce(lambda a, b: a | b, [F.array_contains("segments.tag", t) for t in tags])
    valid = F.when(F.col("format") == "jpeg", has("DA")).when(F.col("format") == "png", has("IHDR") & has("IDAT")).when(F.col("format") == "webp", has("VP8 ", "VP8L")).otherwise(False)
    return rows.withColumn("valid", valid)


def orientation_part(format_: Column, orientation: Column) -> Column:
    """A segment or chunk that holds the orientation alone, for images that must be turned; null for others."""
    block = orientation_block(orientation)
    size, small = lambda n: F.unhex(F.lpad(F.hex(F.lit(n)), 8, "0")), F.unhex(F.lit("1A000000"))
    typed = F.concat(F.encode(F.lit("eXIf"), "US-ASCII"), block)
    crc = F.unhex(F.lpad(F.hex(F.crc32(typed)), 8, "0"))
    jpeg = F.concat(F.unhex(F.lit("FFE1" "0022" "457869660000")), block)
    return F.when(turned(orientation), F.when(format_ == "jpeg", jpeg).when(format_ == "png", F.concat(size(26), typed, crc)).when(format_ == "webp", F.concat(F.encode(F.lit("EXIF"), "US-ASCII"), small, block)))


def clean_images(segmented: DataFrame, keep_orientation: bool = False) -> DataFrame:
    """image_segments' rows with cleaned: the file without what isn't kept, image data byte for byte; null if not valid.

    With keep_orientation, an image that must be turned gets an EXIF block of that one field (column orientation).
    """
    kept = F.when(F.col("valid"), F.filter("segments", lambda s: s["keep"]))
    if not keep_orientation:
        return segmented.withColumn("cleaned", once(put_together)("content", "format", kept, F.lit(None).cast("binary")))
    blocks = F.filter("segments", lambda s: s["kind"].isin("exif", "eXIf", "EXIF"))
    last = F.get(blocks, F.size(blocks) - 1)
    data = F.substring("content", last["data"] + 1, last["stop"] - last["data"])
    tiff = F.when(F.startswith(F.hex(data), F.lit("457869660000")), F.substring(data, 7, F.octet_length(data))).otherwise(data)
    rows = with_exif(segmented.withColumn("_tiff", tiff), "_tiff", "_exif").withColumn("orientation", F.col("_exif.orientation"))
    rows = rows.withColumn("cleaned", once(put_together)("content", "format", kept, orientation_part(F.col("format"), F.col("orientation"))))
    return rows.drop("_tiff", "_exif")


def image_facts(segmented: DataFrame) -> DataFrame:
    """item_id, signal_id, status of the signals that segments show, for valid images."""
    signal = F.create_map(*[F.lit(x) for kv in SIGNAL_OF.items() for x in kv])
    found = F.transform("segments", lambda s: F.element_at(signal, s["kind"]))
    facts = F.array(*[F.struct(F.lit(x).alias("signal_id"), status(F.array_contains(F.array_compact(found), x)).alias("status")) for x in IMAGE_SIGNALS])
    return segmented.filter("valid").select("item_id", F.explode(facts).alias("f")).select("item_id", "f.*")


def clean_and_verify_images(items: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """Clean images, scan the cleaned files again, compare."""
    before = image_segments(items, id_col, content_col)
    after = image_segments(clean_images(before).select("item_id", "cleaned"), "item_id", "cleaned")
    return compare(image_facts(before), image_facts(after))
