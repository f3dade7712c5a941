"""Files that grow by revisions: sections found through pointers from the end of the file, and what each lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.workspace import Workspace

from .graph import overlay

# The words and the shape of the format. An entry has 20 bytes: offset, generation, in use or free, line end.
SECTION, TRAILER, POINTER, BEFORE, ENTRY = "xref", "trailer", "startxref", "/Prev", 20
BLANKS = r"[\x00\t\n\x0C\r ]"
SUBSECTION = rf"(\d{{1,10}}) +(\d{{1,10}}) *(?:\r\n|\r|\n)((?:\d{{10}} \d{{5}} [fn](?: \r| \n|\r\n))*+)"


def _after_blanks(text: Column, offset: Column) -> Column:
    """The offset itself, or that of the next byte which is no blank; null outside the text."""
    blanks = F.length(F.regexp_extract(F.substring(text, offset + 1, F.lit(2**31 - 1)), rf"\A{BLANKS}*+", 0))
    return F.when((offset >= 0) & (offset < F.length(text)), offset + blanks)


def _number(text: Column, word: str) -> Column:
    return F.regexp_extract(text, rf"{word}{BLANKS}+(\d{{1,15}})", 1).try_cast("long")


def sections(files: DataFrame, id_col: str, content_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, offset) to which a file's end points, and every section wherever it lies: item, offset, readable, before, parts.

    before is the offset to which its trailer points; parts are (first, number, entries) as they stand. Whole files are
    read once, in one pass without a shuffle; pointers are followed on this table. A row keeps `item`, the caller's id.
    """
    rows = files.select(F.col(id_col).alias("item"), F.decode(F.col(content_col), "ISO-8859-1").alias("text"))
    # what follows the last pointer word is its number
    last = F.element_at(F.split("text", POINTER), -1)
    named = F.contains("text", F.lit(POINTER))
    end = F.when(named, F.regexp_extract(last, rf"\A{BLANKS}*+(\d{{1,15}})", 1).try_cast("long"))
    rows = rows.withColumn("end", _after_blanks(F.col("text"), end)).withColumn("pieces", F.split("text", rf"(?<!start){SECTION}(?={BLANKS})"))
    heads = rows.select("item", F.col("end").alias("offset"))
    starts = F.aggregate("pieces", F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)) + len(SECTION), F.lit(0)) + F.length(p))))
    each = rows.select("item", "text", F.explode(F.slice(F.arrays_zip(starts.alias("at"), F.slice("pieces", 2, F.size("pieces")).alias("body")), 1, F.size("pieces") - 1)).alias("s"))
    body = F.col("s.body")
    listed, trailer = F.substring_index(body, TRAILER, 1), F.when(F.contains(body, F.lit(TRAILER)), F.substring_index(F.regexp_extract(body, rf"(?s){TRAILER}(.*)\z", 1), POINTER, 1))
    raw = F.transform(F.regexp_extract_all(listed, F.lit(SUBSECTION), F.lit(0)), lambda p: F.struct(*[F.regexp_extract(p, SUBSECTION, k).alias(n) for k, n in ((1, "first"), (2, "number"), (3, "entries"))]))
    parts = F.transform(raw, lambda p: F.struct(p["first"].try_cast("long").alias("first"), p["number"].try_cast("long").alias("number"), p["entries"].alias("entries")))
    whole = F.forall(parts, lambda p: F.length(p["entries"]) == p["number"] * ENTRY)
    other = F.regexp_replace(F.regexp_replace(listed, SUBSECTION, ""), rf"{BLANKS}+", "")
    readable = trailer.isNotNull() & F.contains(trailer, F.lit("<<")) & (F.size(parts) > 0) & whole & (other == "")
    before = _after_blanks(F.col("text"), _number(trailer, BEFORE))
    return heads, each.select("item", F.col("s.at").cast("long").alias("offset"), F.coalesce(readable, F.lit(False)).alias("readable"), before.alias("before"), parts.alias("parts"))


def revision_chains(files: DataFrame, id_col: str, content_col: str) -> tuple[DataFrame, DataFrame]:
    """Every file's revisions, newest first, and the state of the chain: (item, revision, offset, parts) and (item, revisions, state).

    From the end of the file to its last section, from there to the one before, and so on: a round of joins on
    (row, offset) for all files at once. Sections that were seen end the chain, so a loop ends (state "whole", as
    nothing new follows). A pointer to no section, or to one that is not well formed, ends it as "degraded"; a file
    without a pointer, and a null content, is "no table". Rows are told apart by a stored number, so repeated and null ids
    are files of their own.
    """
    ws = Workspace(files.sparkSession)
    rows = ws.save(files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(content_col).alias("content")))
    heads, found = sections(rows, "row", "content")
    found = ws.save(found)
    frontier = ws.save(heads.filter("offset IS NOT NULL").select("item", "offset"))
    seen = broken = None
    revision = 0
    while not frontier.isEmpty():
        met = ws.save(frontier.join(found, ["item", "offset"], "left").withColumn("revision", F.lit(revision)))
        good = met.filter("readable")
        bad = met.filter("NOT coalesce(readable, false)").select("item")
        seen = good if seen is None else seen.union(good)
        broken = bad if broken is None else broken.union(bad)
        following = good.filter("before IS NOT NULL").select("item", F.col("before").alias("offset"))
        frontier = ws.save(following.join(seen.select("item", "offset"), ["item", "offset"], "left_anti"))
        revision += 1
    names = rows.select(F.col("row").alias("item"), "id")
    if seen is None:
        seen = found.withColumn("revision", F.lit(0)).filter("false")
        broken = found.select("item").filter("false")
    counts = seen.groupBy("item").agg(F.count("*").cast("int").alias("revisions"))
    state = names.join(counts, "item", "left").join(broken.withColumn("broken", F.lit(True)), "item", "left")
    told = F.when(F.col("broken"), "degraded").when(F.col("revisions").isNull(), "no table").otherwise("whole")
    chains = seen.select("item", "revision", "offset", "parts").join(names, "item")
    return chains.select("id", "item", "revision", "offset", "parts"), state.select("id", "item", F.coalesce("revisions", F.lit(0)).alias("revisions"), told.alias("state"))


def revision_entries(chains: DataFrame) -> DataFrame:
    """id, item, revision, object, offset of every entry in use; of an object that a section lists twice, the first. Free ones list nothing."""
    parts = chains.select("id", "item", "revision", F.posexplode("parts").alias("part", "p"))
    entries = F.regexp_extract_all(F.col("p.entries"), F.lit(rf"(?s).{{{ENTRY}}}"), F.lit(0))
    each = parts.select("id", "item", "revision", "part", F.col("p.first").alias("first"), F.posexplode(entries).alias("k", "entry"))
    rows = each.select("id", "item", "revision", (F.col("first") + F.col("k")).alias("object"), F.struct("part", "k").alias("at"), F.substring("entry", 1, 10).cast("long").alias("offset"), F.substring("entry", 18, 1).alias("use"))
    return rows.filter("use = 'n'").groupBy("item", "revision", "object").agg(F.min_by("offset", "at").alias("offset"), F.first("id").alias("id")).select("id", "item", "revision", "object", "offset")


def visible_entries(entries: DataFrame, revision: int = 0) -> DataFrame:
    """The entry of each object as that revision sees it: its own, else the newest of those before."""
    return overlay(entries, "item", "object", "revision", revision)
