"""Format detection from leading bytes, as one CASE expression, and the error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 25 * 1024 * 1024


def _starts(content: Column, hexes: str, at: int = 0) -> Column:
    return F.substring(content, at + 1, len(hexes) // 2) == F.unhex(F.lit(hexes))


def _ascii(text: str) -> str:
    return text.encode().hex().upper()


def looks_like_text(content: Column) -> Column:
    """Valid UTF-8 without control characters in the first 4096 bytes."""
    sample = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return F.is_valid_utf8(content.cast("string")) & ~sample.rlike(r"[\x00-\x08\x0E-\x1F]")


def detect_format(content: Column) -> Column:
    """jpeg, png, webp, gif, pdf, bmp, tiff, avif, heic, svg, markdown (any text) or unknown. Signatures need 12 bytes."""
    s = lambda h, at=0: _starts(content, h, at)
    brand = lambda *names: s(_ascii("ftyp"), 4) & F.decode(F.substring(content, 9, 4), "ISO-8859-1").rlike(rf"\A(?:{'|'.join(names)})")
    signature = (
        F.when(s("FFD8FF"), "jpeg").when(s("89504E470D0A1A0A"), "png").when(s(_ascii("RIFF")) & s(_ascii("WEBP"), 8), "webp")
        .when(s(_ascii("GIF87a")) | s(_ascii("GIF89a")), "gif").when(s(_ascii("%PDF-")), "pdf").when(s(_ascii("BM")), "bmp")
        .when(s("49492A00") | s("4D4D002A"), "tiff").when(brand("avif", "avis"), "avif").when(brand("hei", "mif1", "msf1"), "heic")
    )
    head = F.regexp_replace(F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"\A\xEF\xBB\xBF", ""), r"\A[\s\xA0]+", "")
    svg = head.startswith("<svg") | (head.rlike(r"(?i)\A<(\?xml|!--|!DOCTYPE)") & head.rlike(r"(?i)<svg[\s>]"))
    length = F.octet_length(content)
    return F.coalesce(F.when(length == 0, "unknown"), F.when(length >= 12, signature), F.when(svg, "svg"), F.when(looks_like_text(content), "markdown"), F.lit("unknown"))


def error_code(length: Column, format_: Column, scannable: list[str]) -> Column:
    """empty, too-large, unsupported-format or null, in this order."""
    return F.when(length == 0, "empty").when(length > MAX_BYTES, "too-large").when(~format_.isin(*scannable), "unsupported-format")
