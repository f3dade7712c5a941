"""Signals of text formats, in the columns of signal_rows: SVG with the rasters inside it, Markdown, and files of any format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.workspace import Workspace

from ..functions.hidden import hidden_counts
from ..functions.texts import optional_value, strip_tags
from ..functions.xmp import with_xmp
from ..plans.dims import generator_of, role_of
from . import markup
from .detect import MAX_BYTES, detect_format, error_code
from .records import image_records
from .scan import merge_embedded, signal, signal_rows
from .svg import _attrs, _shown, embedded_images, svg_rows

#: What an embedded image's records are said to come from.
EMBEDDED = "Embedded image · "
#: Columns of a scan.
SIGNALS = ("item_id", "group", "ord", "signal_id", "status", "value")


def _region_texts(*elements: str) -> Column:
    """The texts, tags and all, of each element by that name."""
    part = lambda r: F.array_join(F.transform(F.slice("pieces", r["start"] + 1, r["stop"] - r["start"]), lambda p: p["piece"]), "")
    return F.transform(F.filter("regions", lambda r: r["element"].isin(*elements)), part)


def svg_records(items: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """image_records' columns for each readable SVG, and active_content, remote_refs, extra_text, embedded (images with EXIF, XMP, C2PA or texts).

    Own records are titles, descriptions, generators' comments and editors' attributes; XMP is that of metadata
    elements. The images inside are read by image_records, and stand in where the file itself says nothing: the first
    EXIF, XMP and C2PA, all texts. item_id must be unique, as scan_files and stored numbers make it.
    """
    ws = Workspace(items.sparkSession)
    rows = ws.save(svg_rows(items, id_col, content_col).filter("reason is null"))  # read twice below
    record = lambda keyword, text, source: F.struct(keyword.alias("keyword"), text.alias("text"), F.lit(source).alias("source"))
    titled = lambda element, keyword: F.transform(_region_texts(element), lambda t: record(F.lit(keyword), strip_tags(t), f"SVG <{element}>"))
    comments = F.filter("pieces", lambda p: (p["kind"] == "comment") & p["piece"].rlike(r"(?i)generator|generated|created\s+with|produced\s+by|exported\s+from"))
    said = F.transform(comments, lambda p: record(F.lit("Comment"), F.trim(F.regexp_replace(p["piece"], r"\A<!--|-->\z", "")), "XML comment"))
    name, value = lambda a: F.regexp_extract(a["raw"], r"\A\s+([^\s=]+)", 1), lambda a: F.regexp_extract(a["raw"], r"""(?s)=\s*["']?(.*?)["']?\z""", 1)
    edited = F.transform(_attrs("editor"), lambda a: record(name(a), value(a), "Editor attribute"))
    packets = F.filter(_region_texts("metadata", "xmpmeta"), lambda t: t.rlike(r"(?i)xmpmeta|<rdf:RDF|xmlns:rdf"))
    own = rows.select(
        "item_id", F.nullif(F.array_join(packets, ""), F.lit("")).alias("xml"), F.concat(titled("title", "Title"), titled("desc", "Description"), said, edited).alias("own"),
        (F.size(F.filter("regions", lambda r: r["element"] == "script")) + F.size(_attrs("event"))).alias("active_content"), F.size(_attrs("remote")).alias("remote_refs"),
        F.concat_ws("\n", _shown(), F.array_join(F.transform(_attrs("editor"), value), "\n")).alias("extra_text"),
    )
    images = embedded_images(rows).filter("content is not null").select(F.struct("item_id", "place").alias("at"), "content")
    inner = ws.save(image_records(images, "at")).select(F.col("item_id.item_id").alias("file"), F.col("item_id.place").alias("place"), "exif", "xmp", "c2pa", "modified", "iptc", "icc", "extended", "records")
    merged = merge_embedded(inner, "file", "place").select("item_id", "exif", F.col("xmp").alias("_xmp"), "c2pa", "iptc", "icc", F.col("records").alias("_records"), F.col("carriers"))
    joined = ws.save(with_xmp(ws.save(own), "xml").drop("xml")).join(ws.save(merged).hint("merge"), "item_id", "left")
    inside = F.coalesce(F.transform("_records", lambda r: F.struct(r["keyword"].alias("keyword"), r["text"].alias("text"), F.concat(F.lit(EMBEDDED), r["source"]).alias("source"))), F.array().cast("array<struct<keyword:string,text:string,source:string>>"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return joined.select(
        "item_id", F.lit("svg").alias("format"), "exif", F.coalesce("xmp", "_xmp").alias("xmp"), F.lit(False).alias("extended"), no("iptc"), "c2pa", no("icc"),
        F.concat("own", inside).alias("records"), F.lit(None).cast("string").alias("modified"), "active_content", "remote_refs", "extra_text", F.coalesce("carriers", F.lit(0)).cast("int").alias("embedded"),
    )


def _plural(n: Column, word: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))


def markdown_signals(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The signals of Markdown texts: generator and AI keys, embedded texts, author, time and tool of the front matter, hidden characters.

    Comments, JSON-LD and meta tags count where clean_markdown would take them. A null text has no rows.
    """
    rows = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_text"), markup.entries(markup.front_matter(F.col(text_col))).alias("keys"))
    body = F.regexp_replace("_text", markup.BLOCK, "")
    rows = rows.withColumns({
        "_keys": F.transform("keys", lambda k: F.struct(role_of(F.lower(k["name"])).alias("role"), k["value"].alias("value"))),
        "_comments": markup.comments(body), "_json_ld": markup.json_ld(F.col("_text")), "_meta": markup.meta_tags(F.col("_text")), "_hidden": hidden_counts(F.col("_text"))["removable"],
    })
    of = lambda role: F.filter("_keys", lambda k: k["role"] == role)
    value = lambda role: F.get(F.filter(of(role), lambda k: k["value"] != ""), F.lit(0))["value"]
    first = lambda texts: F.get(F.array_compact(F.transform(texts, generator_of)), F.lit(0))
    generator = F.coalesce(generator_of(value("tool")), generator_of(value("ai")), first(F.transform("_meta", lambda m: m["content"])), first(F.col("_comments")), first(F.col("_json_ld")))
    rows = rows.withColumns({"_generator": generator, "_ai": F.size(of("ai"))})
    told = F.concat_ws(" · ", "_generator", F.when(F.col("_ai") == 1, "1 frontmatter key").when(F.col("_ai") > 1, F.concat(F.col("_ai").cast("string"), F.lit(" frontmatter keys"))))
    embedded = F.concat_ws(", ", _plural(F.size("_comments"), "comment"), _plural(F.size("_json_ld"), "structured-data block"), _plural(F.size("_meta"), "meta tag"))
    personal = [signal("privacy", name, optional_value(value(role)).isNotNull(), value(role)) for name, role in (("author", "author"), ("timestamp", "timestamp"), ("software", "tool"))]
    every = F.array(
        signal("provenance", "ai-generator", F.col("_generator").isNotNull() | (F.col("_ai") > 0), told),
        signal("provenance", "claude-watermark", "unable_to_verify"),
        signal("metadata", "embedded-text", embedded != "", embedded),
        *personal,
        signal("hidden", "hidden-unicode", F.col("_hidden") > 0, F.when(F.col("_hidden") > 0, F.concat(F.col("_hidden").cast("string"), F.lit(" in the text")))),
    )
    return rows.select("item_id", F.posexplode(every).alias("ord", "s")).select("item_id", "s.group", "ord", "s.signal_id", "s.status", "s.value")


def _markdown(items: DataFrame) -> DataFrame:
    text = F.col("content").cast("string")
    return markdown_signals(items.select("item_id", F.when(F.is_valid_utf8(text), text).alias("text")))


def _signals(records: DataFrame) -> DataFrame:
    """signal_rows of stored records: one plan of both takes the driver gigabytes to compile."""
    return signal_rows(Workspace(records.sparkSession).save(records))


#: What scans a format. Each takes (item_id, content) and gives the columns SIGNALS.
SCANNERS = {("jpeg", "png", "webp"): lambda items: _signals(image_records(items)), ("svg",): lambda items: _signals(svg_records(items)), ("markdown",): _markdown}


def scan_files(items: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """item_id, format, group, ord, signal_id, status, value: the signals of each file; of one that isn't read a single row with its reason.

    reason is an error code for formats that nothing scans, and "corrupt" for files of a known format without signals.
    Rows are told apart by a stored number, so repeated and null ids are files of their own. Null contents are unknown.
    """
    ws = Workspace(items.sparkSession)
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    rows = ws.save(rows.withColumn("format", F.coalesce(detect_format(F.col("content")), F.lit("unknown"))))
    known = [f for formats in SCANNERS for f in formats]
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    fits = F.col("format").isin(*known) & size.between(1, MAX_BYTES)
    found = None
    for formats, scanner in SCANNERS.items():
        part = scanner(rows.filter(fits & F.col("format").isin(*formats)).select(F.col("row").alias("item_id"), "content")).select(*SIGNALS)
        found = part if found is None else found.unionByName(part)
    found = ws.save(found.withColumnRenamed("item_id", "row"))
    code = F.coalesce(error_code(size, F.col("format"), known), F.when(~F.col("format").isin(*known), "unsupported-format"), F.lit("corrupt"))
    names = rows.select("row", F.col("id").alias("item_id"), "format", code.alias("code"))
    # millions of these rows fit into few MB of parquet, by which Spark would think them fit to broadcast
    out = names.join(found.hint("merge"), "row", "left")
    return out.select("item_id", "format", *SIGNALS[1:], F.when(F.col("signal_id").isNull(), F.col("code")).alias("reason"))
