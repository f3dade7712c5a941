"""SVG as pieces: tags, comments and text in order, classified, cleaned and joined again, a file in its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.workspace import Workspace

from ..functions.slices import by_row
from .containers import clean_images, image_segments, once

# Prefixes of editors' names, elements that go with all they hold, and what generators' comments say.
EDITORS = ("inkscape", "sodipodi", "illustrator", "graph", "i", "figma", "sketch", "xd", "affinity", "vectornator", "krita", "serif")
ELEMENTS = ("metadata", "xmpmeta", "title", "desc", "script")
GENERATOR_COMMENT = r"(?i)generator|generated|created\s+with|produced\s+by|exported\s+from"
ENCODINGS = ("utf-8", "utf8", "us-ascii", "ascii")
#: A name's tag; quoted values may hold '>'.
TAG = r"""</?[A-Za-z_:][\w.:\-]*+(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
#: Every text is a row of these: comment, CDATA, instruction, declaration, tag, or what lies between.
PIECE = rf"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<\?.*?(?:\?>|\z)|<!(?:[^\[\]>]++|\[[^\]]*+\])*+>?|{TAG}|[^<]++|<"
ATTRIBUTE = r"""\s+[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?"""


def decode_svg(content: Column) -> tuple[Column, Column]:
    """The text, and the reason why it is not read: utf-16, not utf-8, other encoding, no svg element; null if there is none."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\A\x{FEFF}", "")
    declared = F.lower(F.regexp_extract(F.substring(text, 1, 512), r"""(?i)<\?xml[^>]*\bencoding\s*=\s*["']([^"']+)["']""", 1))
    reason = (
        F.when(F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"), "utf-16").when(~F.is_valid_utf8(content.cast("string")), "not utf-8")
        .when((declared != "") & ~declared.isin(*ENCODINGS), "other encoding").when(~text.rlike(r"(?i)<svg[\s/>]"), "no svg element")
    )
    return text, reason


def attributes(tag: Column) -> Column:
    """The attributes of a tag as they stand, with the blanks before them."""
    return F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))


def attribute_kind(raw: Column) -> Column:
    """editor-namespace, editor, event, image (base64 within), remote or other."""
    name = F.lower(F.regexp_extract(raw, r"\A\s+([^\s=]+)", 1))
    value = F.trim(F.regexp_extract(raw, r"""(?s)=\s*["']?(.*?)["']?\z""", 1))
    link = name.rlike(r"(?:\A|:)href\z") | (name == "src")
    names = "|".join(EDITORS)
    return (
        F.when(name.rlike(rf"\Axmlns:(?:{names})\z"), "editor-namespace").when(name.rlike(rf"\A(?:{names}):"), "editor").when(name.rlike(r"\Aon[a-z]+\z"), "event")
        .when(link & value.rlike(r"(?i)\Adata:image/"), F.when(value.rlike(r"(?i)\A[^,]*;base64[^,]*,"), "image").otherwise("other"))
        .when((link & value.rlike(r"(?i)\A(?:https?:)?//")) | value.rlike(r"""(?i)url\(\s*['"]?(?:https?:)?//"""), "remote").otherwise("other")
    )


#: What nesting tells: of each piece whether it goes, and of each element where it starts and stops (numbers of pieces).
_REGION = T.StructType([T.StructField("element", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
NESTED = T.StructType([T.StructField("inside", T.ArrayType(T.BooleanType())), T.StructField("regions", T.ArrayType(_REGION))])


def nesting(marks: list[str], most: int) -> dict:
    """marks: '+name' opens, '-name' closes, '=name' does both, '' does nothing; a name is qualified, its last part is the element.

    A name closes the last one open of the same qualified name; one that never closes lasts to the end.
    """
    stacks, regions, open_, inside = {}, [], 0, []
    for i, mark in enumerate(marks):
        kind, name = mark[:1], mark[1:]
        stack = stacks.setdefault(name, []) if kind else []
        closes = kind == "-" and stack
        inside.append(bool(open_ or kind == "=" or kind == "+"))
        if kind in ("+", "="):
            regions.append([name.rsplit(":", 1)[-1], i, i + 1 if kind == "=" else most])
        if kind == "+":
            stack.append(regions[-1])
            open_ += 1
        elif closes:
            stack.pop()[2] = i + 1
            open_ -= 1
    return {"inside": inside, "regions": [dict(zip(("element", "start", "stop"), r)) for r in regions]}


@by_row(NESTED)
def _nesting(marks):
    return {"inside": None, "regions": None} if marks is None else nesting(marks, len(marks))


def svg_rows(items: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """item_id, reason (why it is not read, else null), pieces (piece, kind, element, inside, attrs), regions: a row stays a row, whatever its id.

    kind is comment, tag, close or other; element is one of ELEMENTS that a tag opens, else null; inside: in an element
    that goes. Pieces of files that are not read are null.
    """
    text, reason = decode_svg(F.col(content_col))
    reason = F.when(F.col(content_col).isNull(), "no content").otherwise(reason)
    rows = items.select(F.col(id_col).alias("item_id"), reason.alias("reason"), F.when(reason.isNull(), F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))).alias("raw"))
    name = lambda p: F.lower(F.regexp_extract(p, r"\A</?([\w.:\-]+)", 1))
    tag = lambda p: F.when(p.startswith("<!--"), "comment").when(p.rlike(r"\A</[A-Za-z_:]"), "close").when(p.rlike(r"\A<[A-Za-z_:]") & p.endswith(">"), "tag").otherwise("other")
    rows = rows.withColumn("read", F.transform("raw", lambda p: F.struct(p.alias("piece"), tag(p).alias("kind"), name(p).alias("name"))))
    local = lambda r: F.regexp_extract(r["name"], r"([^:]*)\z", 1)
    known = lambda r: r["kind"].isin("tag", "close") & local(r).isin(*ELEMENTS)
    mark = lambda r: F.when(known(r), F.concat(F.when(r["kind"] == "close", "-").when(r["piece"].endswith("/>"), "=").otherwise("+"), r["name"])).otherwise("")
    rows = rows.withColumn("nested", once(_nesting)(F.transform("read", mark)))
    attrs = lambda r: F.when(r["kind"] == "tag", F.transform(attributes(r["piece"]), lambda a: F.struct(a.alias("raw"), attribute_kind(a).alias("kind"))))
    whole = lambda r, inside: F.struct(r["piece"].alias("piece"), r["kind"].alias("kind"), F.when(known(r) & (r["kind"] == "tag"), local(r)).alias("element"), inside.alias("inside"), attrs(r).alias("attrs"))
    return rows.select("item_id", "reason", F.zip_with("read", "nested.inside", whole).alias("pieces"), F.col("nested.regions").alias("regions"))


def _count(test) -> Column:
    return F.size(F.filter("pieces", test))


def _attrs(*kinds: str) -> Column:
    return F.flatten(F.transform(F.filter("pieces", lambda p: p["attrs"].isNotNull()), lambda p: F.filter(p["attrs"], lambda a: a["kind"].isin(*kinds))))


def _shown() -> Column:
    """Texts of comments and of elements that go, by lines."""
    told = lambda p: F.when(p["kind"] == "comment", F.regexp_replace(p["piece"], r"\A<!--|-->\z", "")).when(p["inside"] & (p["kind"] == "other"), p["piece"])
    return F.array_join(F.array_compact(F.transform("pieces", told)), "\n")


def svg_facts(rows: DataFrame) -> DataFrame:
    """A row for each file of svg_rows that is read: how many of each element, comments, generator comments, and attributes of each kind; shown: text of comments and elements."""
    comment = lambda p: p["kind"] == "comment"
    element = lambda e: _count(lambda p: F.coalesce(p["element"] == e, F.lit(False)))
    counts = {e: element(e) for e in ELEMENTS} | {"comments": _count(comment), "generator_comments": _count(lambda p: comment(p) & p["piece"].rlike(GENERATOR_COMMENT))}
    counts |= {k.replace("-", "_"): F.size(_attrs(k)) for k in ("editor-namespace", "editor", "event", "remote", "image")}
    return rows.filter("reason is null").select("item_id", *[c.cast("long").alias(n) for n, c in counts.items()], _shown().alias("shown"))


def embedded_images(rows: DataFrame, kept_only: bool = False) -> DataFrame:
    """item_id, place, old (base64 as it stands), content: raster images within svg_rows' files, in order; content is null if it is no base64."""
    pieces = F.filter("pieces", lambda p: p["attrs"].isNotNull() & ~p["inside"]) if kept_only else F.filter("pieces", lambda p: p["attrs"].isNotNull())
    raws = F.flatten(F.transform(pieces, lambda p: F.transform(F.filter(p["attrs"], lambda a: a["kind"] == "image"), lambda a: a["raw"])))
    each = rows.select("item_id", F.posexplode(raws).alias("place", "raw")).withColumn("old", F.regexp_extract("raw", r"""(?s),(.*?)["']?\z""", 1))
    return each.select("item_id", "place", "old", F.try_to_binary(F.regexp_replace("old", r"\s", ""), F.lit("base64")).alias("content"))


def clean_svg(items: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """item_id, reason (why not, else null), cleaned (text): without comments, ELEMENTS and all in them, and attributes of editors, events and remote addresses.

    Embedded raster images are cleaned and put back; those that can't be stay. Everything else stays as it was. A row
    for each row: rows are told apart by a stored number, so repeated and null ids are files of their own.
    """
    ws = Workspace(items.sparkSession)
    files = ws.save(items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(content_col).alias("content")))
    rows = svg_rows(files, "row", "content")
    gone = ("editor-namespace", "editor", "event", "remote")
    parts = lambda piece: F.regexp_extract_all(piece, F.lit(rf"(?s){ATTRIBUTE}|\S+|\s+"), F.lit(0))
    dropped = lambda p: F.transform(F.filter(p["attrs"], lambda a: a["kind"].isin(*gone)), lambda a: a["raw"])
    new = lambda p: F.when((p["kind"] == "tag") & (F.size(dropped(p)) > 0), F.array_join(F.filter(parts(p["piece"]), lambda x: ~F.array_contains(dropped(p), x)), "")).otherwise(p["piece"])
    kept = F.filter("pieces", lambda p: ~p["inside"] & (p["kind"] != "comment"))
    images = embedded_images(rows, kept_only=True)
    cleaned = ws.save(rows.select(F.col("item_id").alias("row"), "reason", F.array_join(F.transform(kept, new), "").alias("cleaned")))
    done = clean_images(image_segments(images.select(F.struct("item_id", "old").alias("at"), "content"), "at", "content")).filter("cleaned is not null")
    swaps = done.groupBy(F.col("item_id.item_id").alias("row")).agg(F.collect_set(F.struct(F.col("item_id.old").alias("old"), F.base64("cleaned").alias("new"))).alias("swaps"))
    swapped = F.coalesce(F.aggregate("swaps", F.col("cleaned"), lambda t, s: F.replace(t, s["old"], s["new"])), "cleaned")
    out = cleaned.join(swaps.hint("merge"), "row", "left").select("row", "reason", F.when(F.col("reason").isNull(), swapped).alias("cleaned"))
    return out.join(files.select("row", F.col("id").alias("item_id")).hint("merge"), "row").select("item_id", "reason", "cleaned")


def numeric_attribute(value: Column) -> Column:
    """A plain number, or one of pixels, rounded half up; null otherwise."""
    return F.floor(F.regexp_extract(F.trim(value), r"\A([\d.]+)(?:px)?\z", 1).try_cast("double") + 0.5)
