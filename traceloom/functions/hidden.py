"""Hidden characters as column expressions: counts, findings, cleaning, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intervals import join_ranges

# Hidden code points by category and risk. The first row that holds a code point decides.
HIDDEN = (
    ("zero-width", "high", "200B 200C 200D 2060 FEFF"),
    ("zero-width", "medium", "00AD 180E 2061-2064"),
    ("bidi-control", "medium", "061C 200E 200F"),
    ("bidi-control", "high", "202A-202E 2066-2069"),
    ("control", "low", "2028 2029 000B-000C"),
    ("control", "medium", "0000-0008 000E-001F 007F-009F"),
    ("unusual-space", "medium", "2800"),
    ("unusual-space", "high", "3164 FFA0"),
    ("unusual-space", "low", "00A0 2000-200A 202F 205F 3000"),
    ("variation-selector", "medium", "FE00-FE0F E0100-E01EF"),
    ("tag-character", "high", "E0000-E007F"),
)
# What hidden code points are called.
NAMES = (
    ("Soft hyphen", "00AD"),
    ("Arabic letter mark", "061C"),
    ("Mongolian vowel separator", "180E"),
    ("Zero-width space", "200B"),
    ("Zero-width non-joiner", "200C"),
    ("Zero-width joiner", "200D"),
    ("Left-to-right mark", "200E"),
    ("Right-to-left mark", "200F"),
    ("Line separator", "2028"),
    ("Paragraph separator", "2029"),
    ("Word joiner", "2060"),
    ("Function application", "2061"),
    ("Invisible times", "2062"),
    ("Invisible separator", "2063"),
    ("Invisible plus", "2064"),
    ("Braille pattern blank", "2800"),
    ("Hangul filler", "3164"),
    ("Zero-width no-break space (BOM)", "FEFF"),
    ("Halfwidth Hangul filler", "FFA0"),
    ("Unusual space character", "00A0 2000-200A 202F 205F 3000"),
    ("Control character", "0000-0008 000B-000C 000E-001F 007F-009F"),
    ("Bidirectional override", "202A-202E"),
    ("Bidirectional isolate", "2066-2069"),
    ("Variation selector", "FE00-FE0F"),
    ("Tag character", "E0000-E007F"),
    ("Variation selector (supplement)", "E0100-E01EF"),
)
# Extended_Pictographic of Unicode 16, and the regional indicators.
PICTOGRAPHIC = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171
1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F3FA
1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F
1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD 1F1E6-1F1FF
"""
CATEGORIES = tuple(dict.fromkeys(c for c, _, _ in HIDDEN))


def ranges(spec: str) -> list[tuple[int, int]]:
    """Pairs of code points from text such as '200B FE00-FE0F'."""
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in spec.split())]


def char_class(spec: str) -> str:
    """The inside of a Java character class."""
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges(spec))


def _of(category: str) -> str:
    return char_class(" ".join(s for c, _, s in HIDDEN if c == category))


#: What most texts are made of. Java asks it first, so that a plain character costs two comparisons, not one a range.
_PLAIN = r"\t\n\r -~"


def rare(inside: str) -> str:
    """A class of characters beyond plain ASCII."""
    return f"[[^{_PLAIN}]&&[{inside}]]"


_HIDDEN = char_class(" ".join(s for _, _, s in HIDDEN))
ANY, NONE = rare(_HIDDEN), f"[{_PLAIN}[^{_HIDDEN}]]"
SPACES = rare(_of("unusual-space"))
_P = f"[{char_class(PICTOGRAPHIC)}]"
_SELECTORS, _IDEOGRAPHIC = r"\x{FE0E}\x{FE0F}", r"\x{E0100}-\x{E01EF}"
#: A joiner between pictographs, a selector after one, an ideographic selector after a Han character, as what stands
#: around the place after the character. {1,2} lets Java look back over characters beyond the basic plane.
_JOINS, _SELECTS, _VARIES = rf"(?<={_P}{{1,2}}\x{{200D}})(?={_P})", rf"(?<={_P}{{1,2}}[{_SELECTORS}])", rf"(?<=\p{{IsHan}}{{1,2}}[{_IDEOGRAPHIC}])"
LEGITIMATE = rf"{rare(rf'\x{{200D}}{_SELECTORS}{_IDEOGRAPHIC}')}(?:{_JOINS}|{_SELECTS}|{_VARIES})"
_OTHERS = rare(char_class(" ".join(s for c, _, s in HIDDEN if c != "unusual-space")))
REMOVABLE = rf"{_OTHERS}(?!{_JOINS}|{_SELECTS}|{_VARIES})"
#: Those and the unusual spaces, which become blanks.
CHANGED = rf"{ANY}(?!{_JOINS}|{_SELECTS}|{_VARIES})"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def hidden_counts(text: Column) -> dict[str, Column]:
    """total, legitimate, removable, and a count for each category, of what is left when all that shows is taken out."""
    marks, legitimate = F.regexp_replace(text, f"{NONE}+", ""), count(text, LEGITIMATE)
    by = {"n_" + c.replace("-", "_"): count(marks, f"[{_of(c)}]") for c in CATEGORIES}
    return {"total": F.length(marks), "legitimate": legitimate, "removable": F.length(marks) - legitimate, **by}


def clean_hidden(text: Column, normalize_spaces: bool = True, aggressive: bool = False) -> Column:
    """Unusual spaces become one blank each (or stay); other hidden characters go, legitimate ones only if aggressive."""
    clean = F.regexp_replace(text, SPACES, " ") if normalize_spaces else text
    return F.when(text.rlike(ANY if aggressive else CHANGED), F.regexp_replace(clean, _OTHERS if aggressive else REMOVABLE, "")).otherwise(text)


def named_ranges(spark: SparkSession) -> DataFrame:
    """start, stop, name, category, risk: NAMES as a table, each range with the category and risk of the row of HIDDEN that holds it."""
    held = [(a, b, category, risk) for category, risk, spec in HIDDEN for a, b in ranges(spec)]
    rows = []
    for name, spec in NAMES:
        for a, b in ranges(spec):
            _, _, category, risk = next(h for h in held if h[0] <= a and b <= h[1])
            rows.append((a, b, name, category, risk))
    return spark.createDataFrame(rows, "start int, stop int, name string, category string, risk string")


def findings(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each hidden character: id, idx (code points from 0), cp, code, name, category, risk, legitimate.

    What a code point is comes from the table of named ranges by join_ranges.
    """
    some = items.filter(F.col(text_col).rlike(ANY))
    pictograph = lambda c: F.coalesce(c.rlike(f"^{_P}$"), F.lit(False))
    shows = lambda c: F.ascii(c).between(0x20, 0x7E)

    def found(chars):  # the text is split once: chars is bound by the outer transform
        at = lambda c, i: F.when(~shows(c) & c.rlike(ANY), F.struct(i.alias("idx"), F.get(chars, i - 1).alias("before"), F.get(chars, i + 1).alias("after"), F.ascii(c).alias("cp")))
        return F.filter(F.transform(chars, at), lambda x: x.isNotNull())

    hidden = some.select(id_col, F.explode(F.transform(F.array(F.split(text_col, "")), found)[0]).alias("x")).select(id_col, "x.*")
    joiner = (F.col("cp") == 0x200D) & pictograph(F.col("before")) & pictograph(F.col("after"))
    selector = F.col("cp").isin(0xFE0E, 0xFE0F) & pictograph(F.col("before"))
    ideographic = F.col("cp").between(0xE0100, 0xE01EF) & F.coalesce(F.col("before").rlike(r"^\p{IsHan}$"), F.lit(False))
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.col("cp").cast("long")), F.greatest(F.lit(4), F.length(F.hex(F.col("cp").cast("long")))), F.lit("0")))
    named = join_ranges(hidden, named_ranges(items.sparkSession), "cp")
    return named.select(id_col, "idx", "cp", code.alias("code"), "name", "category", "risk", (joiner | selector | ideographic).alias("legitimate"))


def runs(text: Column, most: int = 4000) -> Column:
    """The first `most` characters as alternating runs of hidden and plain text."""
    return F.regexp_extract_all(F.substring(text, 1, most), F.lit(f"{ANY}+|{NONE}+"), F.lit(0))
