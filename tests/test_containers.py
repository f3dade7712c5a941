"""Image containers, file sources and streams, on files built here byte by byte."""

import struct
import zlib

from pyspark.sql import functions as F

from traceloom.operators.containers import clean_and_verify_images, clean_images, image_segments
from traceloom.sources.files import read_files, with_format
from traceloom.streaming.texts import flagged_per_window

SCAN = b"\xff\xda\x00\x08abcdefsome scan\xff\xd9"


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def riff(kind, data):
    return kind + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)


JFIF, ICC = segment(0xE0, b"JFIF\0" + bytes(9)), segment(0xE2, b"ICC_PROFILE\0x")
JPEG = b"\xff\xd8" + JFIF + segment(0xE1, b"Exif\0\0stuff") + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>") + ICC + segment(0xED, b"Photoshop") + b"\xff" + segment(0xFE, b"note") + SCAN
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IHDR, IDAT, IEND = chunk(b"IHDR", bytes(13)), chunk(b"IDAT", b"pixels"), chunk(b"IEND", b"")
PNG = SIGNATURE + IHDR + chunk(b"tEXt", b"Title\0x") + chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0<x/>") + chunk(b"gAMA", bytes(4)) + chunk(b"prVt", b"?") + IDAT + IEND
VP8X, VP8L = bytes([0x1C]) + bytes(9), b"\x2f" + bytes(6)


def webp(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


WEBP = webp(riff(b"VP8X", VP8X), riff(b"VP8L", VP8L), riff(b"EXIF", b"odd"), riff(b"XMP ", b"<x/>"))
CLEAN = {
    1: b"\xff\xd8" + JFIF + ICC + SCAN,
    2: SIGNATURE + IHDR + chunk(b"gAMA", bytes(4)) + IDAT + IEND,
    3: webp(riff(b"VP8X", bytes([0x10]) + bytes(9)), riff(b"VP8L", VP8L)),
    4: None,
    5: None,
    6: None,
}


def items(spark):
    return spark.createDataFrame([(1, JPEG), (2, PNG), (3, WEBP), (4, JPEG[:40]), (5, b"plain text"), (6, None)], "item_id long, content binary")


def test_clean(spark):
    got = {r["item_id"]: r["cleaned"] and bytes(r["cleaned"]) for r in clean_images(image_segments(items(spark))).collect()}
    assert got == CLEAN


def test_kinds(spark):
    rows = image_segments(items(spark)).filter("item_id = 1").select(F.explode("segments").alias("s")).select("s.kind", "s.keep").collect()
    assert [tuple(r) for r in rows] == [("jfif", True), ("exif", False), ("xmp", False), ("icc", True), ("iptc", False), ("comment", False), ("structural", True)]


def test_verified(spark):
    got = {(r["item_id"], r["signal_id"]): r["outcome"] for r in clean_and_verify_images(items(spark)).collect()}
    assert {k for k, v in got.items() if v == "removed"} == {(1, "exif"), (1, "xmp"), (1, "iptc"), (1, "embedded-text"), (2, "xmp"), (2, "embedded-text"), (3, "exif"), (3, "xmp")}
    assert {k for k, v in got.items() if v == "kept"} == {(1, "icc")}
    assert not {v for v in got.values()} - {"removed", "kept", "absent"}


def test_clean_is_idempotent(spark):
    once = clean_images(image_segments(items(spark))).filter("valid").select("item_id", F.col("cleaned").alias("content"))
    assert clean_images(image_segments(once)).filter("not cleaned <=> content").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in {"a.jpg": JPEG, "deep/b.png": PNG, "deep/c.bin": b"\0\1", "empty.jpg": b"", "long.jpg": JPEG * 40}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: (r["format"], r["error_code"]) for r in with_format(read_files(spark, str(tmp_path), most=len(JPEG) * 20)).collect()}
    assert got == {"a.jpg": ("jpeg", None), "b.png": ("png", None), "c.bin": ("unknown", "unsupported-format")}
    assert {r["name"] for r in read_files(spark, str(tmp_path), "*.[pP][nN][gG]").collect()} == {"b.png"}


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts, if(id % 3 = 0, concat('a', char(8203), 'b'), 'ab') AS text FROM range(12)")
    rows = rows.withColumn("text", F.when(F.col("text") == "ab", "ab").otherwise("a​b"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = flagged_per_window(stream, "ts", "text").writeStream.format("memory").queryName("flagged").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.sql("SELECT texts, flagged FROM flagged ORDER BY start").collect()]
    assert got == [(6, 2), (6, 2)]
