"""Display-safe values, file names, sizes and small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hidden import char_class

# What never shows in a displayed value, and white space.
INVISIBLE = f"[{char_class('0000-0008 000B-001F 007F-009F 200B-200F 202A-202E 2060-2064 2066-2069 FEFF')}]"
SPACE = f"[{char_class('0009-000D 0020 00A0 1680 2000-200A 2028 2029 202F 205F 3000 FEFF')}]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def sanitize_value(text: Column, most: int = 300) -> Column:
    """Without invisible characters, blanks collapsed and trimmed, cut with an ellipsis after `most` characters."""
    clean = trim_space(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), f"{SPACE}+", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def optional_value(text: Column) -> Column:
    return F.nullif(sanitize_value(text), F.lit(""))


def sanitize_filename(name: Column) -> Column:
    """The last part of a path without characters that file systems refuse; 'image' if nothing is left."""
    last = F.element_at(F.split(name, r"[/\\]"), -1)
    clean = trim_space(F.regexp_replace(F.regexp_replace(last, INVISIBLE, ""), r'["<>|:*?]', ""))
    return F.when(F.length(clean) > 0, F.substring(clean, 1, 120)).otherwise(F.lit("image"))


def split_extension(name: Column) -> tuple[Column, Column]:
    """Base and extension at the last dot that isn't the first character."""
    split = name.rlike(r"(?s)\A.+\.[^.]*\z")
    return F.when(split, F.regexp_extract(name, r"(?s)\A(.+)\.([^.]*)\z", 1)).otherwise(name), F.when(split, F.regexp_extract(name, r"(?s)\A(.+)\.([^.]*)\z", 2)).otherwise(F.lit(""))


def format_bytes(size: Column) -> Column:
    """1023 B, 1.5 KB, 2.0 MB; halves round up."""
    one = lambda unit: F.round(size.cast("decimal(20,0)") / F.lit(unit).cast("decimal(20,0)"), 1).cast("decimal(20,1)").cast("string")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(one(1 << 10), F.lit(" KB"))).otherwise(F.concat(one(1 << 20), F.lit(" MB")))


def strip_tags(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, "<[^>]*>", " "))


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 3, "1-3").when(n <= 10, "4-10").otherwise("11+")


#: A word, whose plain characters cost two comparisons each, not one a range of SPACE.
WORD = f"[!-~[^{SPACE[1:]}]++"


def word_number(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def host(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"\Awww\.", "")
