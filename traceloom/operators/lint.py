"""Content rules over Markdown items, as rows (item, level, rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import word_number
from .markup import BLOCK, front_matter

# Keys that front matter must have, and US spellings that are errors.
REQUIRED = ("title", "description", "summary", "publishDate", "order")
US_SPELLINGS = "artifact artifacts behavior behaviors analyze analyzed analyzing sanitize sanitized organization organizations color colors recognize optimize"
FEW_WORDS, MANY_WORDS = 600, 2200


def lint(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each finding; an item without a closed front-matter block has that finding alone."""
    text = F.col(text_col)
    # columns of their own, so that each is found once, not once for each rule that asks for it
    rows = items.select(id_col, text.rlike(BLOCK).alias("_fenced"), front_matter(text).alias("_block"), F.regexp_replace(text, BLOCK, "").alias("_body"))
    rows = rows.withColumns({"_words": word_number(F.col("_body")), "_prose": F.regexp_replace(F.regexp_replace("_body", r"https?://\S+", " "), r"\]\([^)]*\)", "] ")})
    fenced, block, body, words, prose = (F.col(c) for c in ("_fenced", "_block", "_body", "_words", "_prose"))
    rule = lambda when, level, name: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule")))
    rules = [
        *[rule(~block.rlike(rf"(?m)^{key}\s*:"), "ERROR", f"missing {key}") for key in REQUIRED],
        rule(block.rlike(r"(?m)^[A-Za-z_][\w.-]*:[ \t]+[^\"'\[{|>\s][^\n]*: "), "ERROR", "unquoted colon"),
        rule(block.rlike(r"(?m)^[A-Za-z_][\w.-]*:[ \t]+'[^'\n]*[^'\n]'[^'\n]+'[ \t]*$"), "ERROR", "apostrophe"),
        rule(words < FEW_WORDS, "WARN", "few words"),
        rule(words > MANY_WORDS, "WARN", "many words"),
        rule(~body.rlike(r"\]\(/"), "ERROR", "no internal link"),
        rule(prose.rlike(rf"(?i)\b(?:{US_SPELLINGS.replace(' ', '|')})\b"), "ERROR", "US spelling"),
    ]
    found = F.when(fenced, F.filter(F.array(*rules), lambda r: r.isNotNull())).otherwise(F.array(F.struct(F.lit("ERROR").alias("level"), F.lit("no front matter").alias("rule"))))
    return rows.select(id_col, F.explode(found).alias("r")).select(id_col, "r.level", "r.rule")


def duplicate_titles(items: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """Items whose title others have too: how many have it, and the first of them, by which the others are found. A hot title is one row of counts.

    Null titles are no title; rows that share an id count as items of their own.
    """
    counts = items.groupBy(title_col).agg(F.count("*").alias("sharing"), F.min(id_col).alias("first")).filter("sharing > 1")
    return items.join(counts, title_col).select(id_col, "sharing", "first")


def lint_totals(findings: DataFrame, id_col: str) -> DataFrame:
    return findings.groupBy().agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"), F.countDistinct(id_col).alias("items"))

