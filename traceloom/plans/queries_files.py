"""The registered queries over files made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.workspace import Workspace

from ..functions.xmp import FIELDS, with_xmp
from ..operators import audit, guides, markup, scan, svg
from ..operators.cleaning import clean_files
from ..operators.exif import orientation_label, show_position, turned, with_exif
from ..operators.records import image_records
from ..operators.verify import compare
from ..sources.files import pasted
from . import made
from .queries import made_facts, table



def key():
    """The id by which files are made."""
    return F.col("doc_id")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def files(spark, sf_dir, make):
    return documents(spark, sf_dir).select(key().alias("item_id"), make(key()).alias("content"))


def markdown_clean(spark, sf_dir):
    made_guides = documents(spark, sf_dir).select("doc_id", made.guide(key()).alias("md"))
    out = markup.clean_markdown(made_guides, "doc_id", "md")
    return out.select("doc_id", F.md5("cleaned").alias("cleaned"), F.array_join("removed_keys", ",").alias("removed_keys"), "comments", "json_ld", "meta_tags", "hidden")


def fm_paths(spark, sf_dir):
    made_guides = documents(spark, sf_dir).select("doc_id", made.guide(key()).alias("md"))
    return markup.front_matter_keys(made_guides, "doc_id", "md").groupBy("path", "role").agg(F.count("*").alias("n"), F.max(F.col("last") - F.col("line")).alias("most_lines"))


def svg_scan(spark, sf_dir):
    return svg.svg_facts(svg.svg_rows(files(spark, sf_dir, made.svg), "item_id", "content"))


def svg_clean(spark, sf_dir):
    return svg.clean_svg(files(spark, sf_dir, made.svg)).select("item_id", "reason", F.md5("cleaned").alias("cleaned"))


def xmp_facts(spark, sf_dir):
    i = key()
    name = F.coalesce("source", F.lit("none"))
    creator = F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit('<a:D dc:creator="'), name, F.lit(' &amp; &#169;" />'))).when(F.pmod(i, F.lit(3)) == 1, F.concat(F.lit("<dc:creator x='1'><rdf:Seq><rdf:li> "), name, F.lit("\n&lt;x&gt;</rdf:li><rdf:li>z</rdf:li></rdf:Seq></dc:creator>"))).otherwise("<dc:creator> </dc:creator>")
    kind = F.when(F.pmod(i, F.lit(4)) == 0, '<e:DigitalSourceType rdf:resource="http://x/print"/>').when(F.pmod(i, F.lit(4)) == 1, "<e:DigitalSourceType>http://x/trainedAlgorithmicMedia</e:DigitalSourceType>").otherwise("")
    packet = F.concat(F.lit('<x xmlns:dc="u1" xmlns:xmp="u2" xmlns:b="u1">'), creator, kind, made.when(i, 5, '<q xmp:Software="ComfyUI 1"/>'), F.lit("</x>"))
    rows = with_xmp(documents(spark, sf_dir).select("doc_id", packet.alias("xml")), "xml")
    return rows.select("doc_id", *[F.col(f"xmp.{f}").alias(f) for f in FIELDS if f in ("creator", "source_type", "creator_tool")], "xmp.source_label", "xmp.indicates_ai", "xmp.generator", F.array_join("xmp.namespaces", ",").alias("namespaces"), "xmp.mentions_c2pa")


def exif_facts(spark, sf_dir):
    rows = with_exif(documents(spark, sf_dir).select("doc_id", made.tiff(key()).alias("tiff")), "tiff")
    e = lambda n: F.col(f"exif.{n}")
    return rows.select("doc_id", e("make").alias("make"), e("orientation").alias("orientation"), turned(e("orientation")).alias("turned"), orientation_label(e("orientation")).alias("label"), e("lat").alias("lat"), e("lon").alias("lon"), show_position(e("lat"), e("lon")).alias("shown"), e("tag_count").alias("tag_count"))


def png_records(spark, sf_dir):
    rows = image_records(documents(spark, sf_dir).select(key().alias("item_id"), made.png(key()).alias("content")))
    told = F.array_join(F.transform("records", lambda r: F.concat_ws("=", r["keyword"], r["text"], r["source"])), ";")
    return rows.select("item_id", "width", "height", "animated", told.alias("records"), "modified", F.col("xmp.creator").alias("creator"), F.col("exif.make").alias("make"), F.array_join("unknown", ",").alias("unknown"), scan.generator().alias("generator"))


def jpeg_signals(spark, sf_dir):
    return scan.signal_rows(image_records(files(spark, sf_dir, made.jpeg)))


def signal_groups(spark, sf_dir):
    found = scan.found_per_group(scan.signal_rows(image_records(files(spark, sf_dir, made.jpeg))))
    return found.groupBy("group", "found", "total").agg(F.count("*").alias("files"))


def jpeg_notes(spark, sf_dir):
    rows = scan.notes(image_records(files(spark, sf_dir, made.jpeg)))
    return rows.select("item_id", F.array_join("notes", "; ").alias("notes"))


def embedded_merge(spark, sf_dir):
    """Images of ten documents each as carriers of one file."""
    rows = image_records(files(spark, sf_dir, made.jpeg)).withColumn("file", F.floor(F.col("item_id") / 10))
    merged = scan.merge_embedded(rows, "file", "item_id")
    return merged.select("item_id", F.col("exif.make").alias("make"), F.col("xmp.creator_tool").alias("creator_tool"), F.col("c2pa.claim_generator").alias("claim"), "extended", F.size("records").alias("texts"), "carriers")


def files_clean(spark, sf_dir):
    """Every document as one of five kinds of file by id, each cleaned by its own cleaner."""
    kind = F.pmod(key(), F.lit(5))
    content = F.when(kind == 0, made.jpeg(key())).when(kind == 1, made.png(key())).when(kind == 2, made.svg(key())).when(kind == 3, made.utf8(made.guide(key()))).otherwise(made.raw(b"GIF89a" + bytes(9)))
    ws = Workspace(spark)
    out = ws.save(clean_files(ws.save(documents(spark, sf_dir).select(key().alias("item_id"), content.alias("content")))))
    again = image_records(out.filter("format in ('jpeg', 'png')").select("item_id", F.col("cleaned").alias("content")))
    left = again.select("item_id", F.col("exif.orientation").alias("orientation"), F.size("records").alias("records"), F.col("xmp").isNotNull().alias("xmp"))
    return out.join(left, "item_id", "left").groupBy("format", "reason", "orientation", "records", "xmp").agg(F.count("*").alias("files"), F.count("cleaned").alias("cleaned"))


def outcome_lists(spark, sf_dir):
    after = made_facts(spark, sf_dir, 2).filter("(item_id + ord) % 13 <> 0").drop("ord")
    out = scan.outcome_lists(compare(made_facts(spark, sf_dir).drop("ord"), after, blocks=["exif", "xmp"]))
    return out.select("item_id", F.array_join("removed", ",").alias("removed"), F.array_join("remaining", ",").alias("remaining"), F.array_join("stubborn", ",").alias("stubborn"), "before", "gone")


def lint_guides(spark, sf_dir):
    made_guides = documents(spark, sf_dir).select("doc_id", made.ruled_guide(key()).alias("md"))
    return guides.lint_guides(made_guides, "doc_id", "md")


def guide_collection(spark, sf_dir):
    made_guides = documents(spark, sf_dir).select("doc_id", made.ruled_guide(key()).alias("md"))
    rows = guides.read_guides(made_guides, "doc_id", "md", "the house")
    return rows.select("doc_id", "title", "author", "content_type", "publish_date", "order", F.col("n_faq").cast("int").alias("n_faq"), F.array_join("problems", ",").alias("problems"))


def refusals(spark, sf_dir):
    said = F.array(F.lit("Sorry."), F.element_at(F.array(*[F.lit(f"It {w.upper()}!") for w, _ in audit.REFUSALS], F.lit("No.")), (F.pmod(F.col("event_id"), F.lit(len(audit.REFUSALS) + 1)) + 1).cast("int")))
    rows = table(spark, sf_dir, "events").select(audit.refusal(said).alias("label"))
    return audit.report({"refusals": rows.groupBy("label").agg(F.count("*").alias("n"))})


def size_ratios(spark, sf_dir):
    ratio = F.round(F.col("value") / 100, 2)
    return audit.rank_quantiles(table(spark, sf_dir, "events").select("event_type", ratio.alias("ratio")), "ratio", ["event_type"], [0.5])


def preservation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey", F.pmod("o_orderkey", F.lit(9))).alias("before"))
    order = F.col("o_orderkey")
    after = F.when(F.pmod(order, F.lit(10)) == 0, None).when(F.pmod(order, F.lit(7)) == 0, F.slice("before", 1, 1)).when(F.pmod(order, F.lit(6)) == 0, F.reverse("before")).otherwise(F.col("before"))
    return audit.preservation(o.withColumn("after", after), "before", "after")


def pasted_texts(spark, sf_dir):
    out = pasted(documents(spark, sf_dir).select("doc_id", "text"), "text", 1000)
    return out.select("doc_id", "truncated", F.md5("text").alias("text"))


def scalars(spark, sf_dir):
    raw = F.when(F.pmod(key(), F.lit(6)) == 0, F.concat(F.lit("'it''s "), key().cast("string"), F.lit("'"))).when(F.pmod(key(), F.lit(6)) == 1, key().cast("string")).when(F.pmod(key(), F.lit(6)) == 2, F.concat(key().cast("string"), F.lit(".5"))).when(F.pmod(key(), F.lit(6)) == 3, "true").when(F.pmod(key(), F.lit(6)) == 4, "~").otherwise('"a \\"b\\""')
    listed = F.concat(F.lit("['x, y', "), key().cast("string"), F.lit(', "z"'), made.when(key(), 2, ", "), F.lit("]"))
    s = guides.scalar(raw)
    return documents(spark, sf_dir).select("doc_id", s["kind"].alias("kind"), s["value"].alias("value"), F.array_join(F.transform(guides.inline_array(listed), lambda x: F.concat(x["kind"], F.lit(":"), x["value"])), "|").alias("items"))


def newest_guides(spark, sf_dir):
    """The six newest orders, their dates as people write them: a top-k by design."""
    o = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(6)
    return o.select("o_orderkey", F.date_format("o_orderdate", "d MMMM yyyy").alias("shown"))


QUERIES = {f.__name__: f for f in (
    markdown_clean, fm_paths, svg_scan, svg_clean, xmp_facts, exif_facts, png_records, jpeg_signals, signal_groups, jpeg_notes, embedded_merge, files_clean, outcome_lists,
    lint_guides, guide_collection, refusals, size_ratios, preservation, pasted_texts, scalars, newest_guides,
)}
