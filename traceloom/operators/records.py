"""What image files tell: segments' payloads folded to EXIF, XMP, C2PA and text records, one row a file."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.c2pa import c2pa_record
from ..functions.numbers import byte, latin, lossy, unsigned
from ..functions.slices import by_row
from ..functions.xmp import with_xmp
from .containers import image_segments, keeps
from .exif import with_exif

#: Bytes of an embedded text that are read.
TEXT_BYTES = 512 * 1024
# Lengths of the identifiers before EXIF and XMP payloads, and the keyword of XMP in PNG text.
EXIF_ID, XMP_ID, EXTENSION_ID, PNG_XMP = 6, 29, 35, "XML:com.adobe.xmp"
TEXT_CHUNKS = ("tEXt", "zTXt", "iTXt", "iTXt-xmp")


def inflated(data: bytes | None, most: int = TEXT_BYTES + 1) -> bytes | None:
    """The first bytes of a zlib stream, one more than are shown; None if it is broken."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, most) if data else None
    except zlib.error:
        return None
    return out if out is not None and (stream.eof or len(out) == most) else None


@by_row(T.ArrayType(T.BinaryType()))
def inflate_all(streams):
    return None if streams is None else [inflated(x) for x in streams]


def payload(content: Column, segment: Column, format_: Column) -> Column:
    """A segment's bytes, without what frames it."""
    tail = F.when(format_ == "png", 4).otherwise(0)
    return F.substring(content, segment["data"] + 1, F.greatest(segment["stop"] - segment["data"] - tail, F.lit(0)))


def text_chunk(kind: Column, data: Column) -> Column:
    """keyword, source (chunk type), packed, body (bytes, still packed if so) of a PNG text chunk; null if it is malformed.

    tEXt: keyword, NUL, text. zTXt: keyword, NUL, method, packed text. iTXt: keyword, NUL, flag,
    method, language, NUL, translated keyword, NUL, text.
    """
    fields = F.split(latin(data), "\0", 2)
    rest = F.get(fields, F.lit(1))
    skip = F.length(F.get(fields, F.lit(0))) + 1
    international = kind.startswith("iTXt")
    parts = F.split(F.substring(rest, 3, F.length(rest)), "\0", 3)  # language, translated keyword, text
    body = F.when(kind == "tEXt", skip).when(kind == "zTXt", skip + 1).otherwise(skip + 2 + F.length(F.get(parts, F.lit(0))) + F.length(F.get(parts, F.lit(1))) + 2)
    whole = rest.isNotNull() & (~international | (F.size(parts) == 3))
    packed = (kind == "zTXt") | (international & (byte(data, skip) == 1))
    record = F.struct(F.get(fields, F.lit(0)).alias("keyword"), F.regexp_replace(kind, "-xmp", "").alias("source"), packed.alias("packed"), F.substring(data, body + 1, F.octet_length(data)).alias("body"))
    return F.when(whole, record)


def extended_xmp(parts: Column) -> Column:
    """The bytes of extended XMP: parts (offset, data) laid out by offset, later ones over earlier ones, gaps as zeros."""
    place = lambda buf, p: F.when(p["offset"] >= F.octet_length(buf), F.concat(buf, F.unhex(F.repeat(F.lit("00"), (p["offset"] - F.octet_length(buf)).cast("int"))), p["data"])).otherwise(
        F.concat(F.substring(buf, F.lit(1), p["offset"].cast("int")), p["data"], F.substring(buf, (p["offset"] + F.octet_length(p["data"]) + 1).cast("int"), F.octet_length(buf)))
    )
    return F.aggregate(F.array_sort(parts), F.unhex(F.lit("")), place)


def _dimensions(format_: Column, tags: Column) -> Column:
    """width and height from the parts (tag, head) of a file: JPEG's frame, PNG's header, WebP's extended, lossless or lossy header."""
    first = lambda pattern: F.get(F.filter(tags, lambda t: t["tag"].rlike(rf"\A(?:{pattern})\z")), F.lit(0))["head"]
    frame, header = first("C[0-35-79-BD-F]"), first("IHDR")
    extended, lossless, lossy_ = first("VP8X"), first("VP8L"), first("VP8 ")
    bits = unsigned(lossless, 1, 4, True)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    webp = F.when(extended.isNotNull(), size(unsigned(extended, 4, 3, True) + 1, unsigned(extended, 7, 3, True) + 1)).when(
        lossless.isNotNull(), size(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1)
    ).when(lossy_.isNotNull(), size(unsigned(lossy_, 6, 2, True).bitwiseAND(0x3FFF), unsigned(lossy_, 8, 2, True).bitwiseAND(0x3FFF)))
    return F.when(format_ == "jpeg", size(unsigned(frame, 3, 2), unsigned(frame, 1, 2))).when(format_ == "png", size(unsigned(header, 0, 4), unsigned(header, 4, 4))).otherwise(webp)


def image_records(items: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """A row for each readable image: item_id, format, width, height, animated, exif, xmp, extended, iptc, c2pa, icc, adobe, records, modified, unknown, truncated.

    records are its texts (keyword, text, source). Of several EXIF and IPTC blocks the last counts; XMP
    and C2PA blocks are joined. truncated: a text of more than TEXT_BYTES was cut. unknown lists APP segments or optional chunks that nothing here knows.
    """
    rows = image_segments(items, id_col, content_col).filter("valid")
    format_ = F.col("format")
    data = lambda s: payload(F.col("content"), s, format_)
    parts = F.transform("segments", lambda s: F.struct(s["tag"].alias("tag"), s["kind"].alias("kind"), F.when(s["tag"].isin("DA", "IDAT", "fdAT", "ANMF"), None).otherwise(data(s)).alias("data")))
    rows = rows.withColumn("parts", parts).select("item_id", "format", "parts")
    of = lambda *kinds: F.transform(F.filter("parts", lambda p: p["kind"].isin(*kinds)), lambda p: p["data"])
    last = lambda many: F.get(many, F.size(many) - 1)
    after = lambda d, n: F.substring(d, n + 1, F.octet_length(d))
    jpeg, webp = format_ == "jpeg", format_ == "webp"
    exif = F.when(jpeg, last(F.filter(F.transform(of("exif"), lambda d: after(d, EXIF_ID)), lambda d: F.octet_length(d) > 0))).otherwise(last(of("eXIf", "EXIF")))
    exif = F.when(webp & F.startswith(F.hex(exif), F.lit("457869660000")), after(exif, EXIF_ID)).otherwise(exif)
    pieces = F.transform(of("xmp-extension"), lambda d: F.struct(unsigned(d, EXTENSION_ID + 36, 4).alias("offset"), after(d, EXTENSION_ID + 40).alias("data")))
    main = F.array_join(F.transform(of("xmp"), lambda d: lossy(after(d, XMP_ID))), "")
    jpeg_xmp = F.concat(main, lossy(extended_xmp(F.filter(pieces, lambda p: p["offset"].isNotNull()))))
    skip = lambda d: F.when(F.hex(F.substring(d, 1, 2)) == "4A50", after(d, 10)).otherwise(d)
    box = F.aggregate(F.transform(of("jumbf"), skip), F.unhex(F.lit("")), lambda a, d: F.concat(a, d))
    chunks = F.filter(F.transform(F.filter("parts", lambda p: p["kind"].isin(*TEXT_CHUNKS)), lambda p: text_chunk(p["kind"], p["data"])), lambda c: c.isNotNull())
    rows = rows.withColumns({"tiff": exif, "jpeg_xmp": jpeg_xmp, "box": F.when(jpeg, box).otherwise(last(of("caBX", "C2PA"))), "chunks": chunks})
    rows = rows.withColumn("unpacked", inflate_all.asNondeterministic()(F.transform("chunks", lambda c: F.when(c["packed"], c["body"]))))
    whole = lambda c, i: F.when(c["packed"], F.get("unpacked", i)).otherwise(c["body"])
    text = lambda c, i: lossy(F.substring(whole(c, i), 1, TEXT_BYTES))
    rows = rows.withColumn("truncated", F.exists(F.transform("chunks", lambda c, i: F.octet_length(whole(c, i)) > TEXT_BYTES), lambda long: F.coalesce(long, F.lit(False))))
    read = F.transform("chunks", lambda c, i: F.struct(c["keyword"].alias("keyword"), F.coalesce(text(c, i), F.lit("")).alias("text"), c["source"].alias("source")))
    rows = rows.withColumn("texts", read)
    is_xmp = lambda t: (t["keyword"] == PNG_XMP) & (t["text"] != "")
    packets = F.filter("texts", is_xmp)
    xml = F.when(jpeg, F.nullif(F.col("jpeg_xmp"), F.lit(""))).when(webp, lossy(last(of("XMP ")))).otherwise(last(packets)["text"])
    comment = F.filter(F.transform(of("comment"), lambda d: F.struct(F.lit("Comment").alias("keyword"), lossy(d).alias("text"), F.lit("JPEG comment").alias("source"))), lambda c: F.trim(c["text"]) != "")
    time = last(F.filter(of("tIME"), lambda d: F.octet_length(d) >= 7))
    modified = F.when(time.isNotNull(), F.format_string("%d-%02d-%02d %02d:%02d:%02d", unsigned(time, 0, 2), *[byte(time, k) for k in range(2, 7)]))
    odd = F.transform(F.filter("parts", lambda p: F.when(jpeg, p["kind"] == "app-unknown").otherwise(~keeps(format_, p["kind"]) & ~p["kind"].isin(*TEXT_CHUNKS, "eXIf", "tIME", "caBX", "dSIG", "EXIF", "XMP ", "C2PA"))), lambda p: p["tag"])
    heads = F.transform("parts", lambda p: F.struct(p["tag"].alias("tag"), F.substring(p["data"], 1, 16).alias("head")))
    size = _dimensions(format_, heads)
    animated = F.when(format_ == "png", F.size(of("acTL")) > 0).when(webp, F.coalesce(byte(F.get(of("VP8X"), F.lit(0)), 0).bitwiseAND(2) > 0, F.lit(False))).otherwise(False)
    rows = rows.select(
        "item_id", "format", size["width"].alias("width"), size["height"].alias("height"), animated.alias("animated"), "tiff", F.when(F.trim(xml) != "", xml).alias("xml"), (F.size(of("xmp-extension")) > 0).alias("extended"),
        F.coalesce(F.octet_length(last(of("iptc"))) > 0, F.lit(False)).alias("iptc"), c2pa_record(F.col("box")).alias("c2pa"), (F.size(of("icc", "iCCP", "ICCP")) > 0).alias("icc"), (F.size(of("adobe")) > 0).alias("adobe"),
        F.when(jpeg, comment).otherwise(F.filter("texts", lambda t: ~is_xmp(t))).alias("records"), modified.alias("modified"), odd.alias("unknown"), "truncated",
    )
    return with_xmp(with_exif(rows, "tiff"), "xml").drop("tiff", "xml")
