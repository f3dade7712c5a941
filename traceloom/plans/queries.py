"""The registered queries over the driver's tables. Signals that these lack are put in by key, on both sides alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.workspace import Workspace

from ..functions import digests as D
from ..functions import hidden as H
from ..functions import texts as T
from ..operators import audit, graph, limiter, markup
from ..operators.containers import clean_and_verify_images
from ..operators.detect import detect_format, error_code
from ..operators.lint import duplicate_titles, lint, lint_totals
from ..operators.verify import clean_and_verify, compare, exposure, text_facts
from . import dims
from .queries_data import GENERATOR_CYCLE, MARKERS, SIGNATURES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key, values):
    """values[key mod n]."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def marked_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.concat(F.substring("text", 1, 3), pick(F.col("doc_id"), MARKERS), F.expr("substring(text, 4)")).alias("text"))


def markdown_documents(spark, sf_dir):
    d, mod = table(spark, sf_dir, "documents"), lambda n: F.pmod("doc_id", F.lit(n))
    bare = F.concat(F.lit("---\ngenerator: tool\ndate: 2026-01-01\n---\n\n"), F.col("text"))
    prompt = F.when(mod(3) == 0, "prompt: |\n  line one\n  line two\n").otherwise("")
    unsafe = F.when(mod(7) == 0, "base: &anchor x\n").otherwise("")
    block = F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id").cast("string"), F.lit("\nauthor: "), F.col("source"), F.lit("\ngenerator: "), pick(F.col("doc_id"), GENERATOR_CYCLE), F.lit("\ndate: 2026-01-0"), (mod(9) + 1).cast("string"), F.lit("\n"), prompt, unsafe, F.lit("layout: post\n---\n\n"), F.col("text"))
    tail = F.when(mod(5) == 0, "\n<!-- generated by tool -->").otherwise("")
    return d.select("doc_id", F.concat(F.when(mod(11) == 0, bare).otherwise(block), tail).alias("md"))


def marked_pages(spark, sf_dir):
    p, mod = table(spark, sf_dir, "pages"), lambda n: F.pmod("page_id", F.lit(n)) == 0
    add = lambda n, s: F.when(mod(n), s).otherwise("")
    extra = [add(4, '<script type="application/ld+json"> {"@type":"X"} </script>'), add(3, '<meta name="generator" content="Gen 1">'), add(5, '<body onload="x()">'), add(6, '<img src="https://t.example/p.png">'), add(2, "<!-- exported by model 7 -->")]
    return p.select("page_id", "url", F.concat("html", *extra).alias("html"))


# hidden characters
def hidden_scan(spark, sf_dir):
    counts = H.hidden_counts(F.col("text"))
    d = marked_documents(spark, sf_dir).select("lang", *[c.alias(n) for n, c in counts.items()])
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("removable") > 0).alias("flagged"), *[F.sum(n).alias(n) for n in counts])


def hidden_findings(spark, sf_dir):
    return H.findings(marked_documents(spark, sf_dir), "doc_id", "text")


def hidden_clean(spark, sf_dir):
    d, text = marked_documents(spark, sf_dir), F.col("text")
    return d.select("doc_id", F.md5(H.clean_hidden(text)).alias("cleaned"), F.md5(H.clean_hidden(text, aggressive=True)).alias("aggressive"), F.md5(H.clean_hidden(text, normalize_spaces=False)).alias("spaces_kept"))


def hidden_runs(spark, sf_dir):
    d = marked_documents(spark, sf_dir).select("doc_id", F.posexplode(H.runs(F.col("text"))).alias("pos", "run"))
    return d.select("doc_id", "pos", F.length("run").alias("len"), F.col("run").rlike(H.ANY).alias("hidden"))


def text_clean_verify(spark, sf_dir):
    return clean_and_verify(marked_documents(spark, sf_dir), "doc_id", "text").groupBy("signal_id", "before_status", "after_status", "outcome").agg(F.count("*").alias("n"))


# display and small functions
def sanitize_values(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    value = T.sanitize_value(F.concat(F.lit(" \u200b "), F.col("text"), F.lit("\t\u3000\ufeff")))
    return c.select("conv_id", "turn", F.length(value).alias("len"), F.md5(value).alias("value"))


def filename_ops(spark, sf_dir):
    name = T.sanitize_filename(F.concat(F.col("url"), F.lit('?a<b>|:c"*.v1.html')))
    base, ext = T.split_extension(name)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), base.alias("base"), ext.alias("ext"), F.concat(base, F.lit("-clean.jpg")).alias("cleaned"))


def size_format(spark, sf_dir):
    size = F.col("n_chars") * F.pmod("doc_id", F.lit(1500))
    return table(spark, sf_dir, "documents").select("doc_id", T.format_bytes(size).alias("shown"))


def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("plain"), T.host(F.col("url")).alias("host"))


def word_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_number(F.col("text")).cast("long").alias("words"))


def digests(spark, sf_dir):
    """Of the bytes of every document, from pieces of 4,096."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    rows = Workspace(spark).save(d.withColumn("crc32", F.crc32("content")))
    whole = D.digest_of_chunks(D.chunks(rows, "doc_id", "content", 4096), ["doc_id"])
    return whole.join(rows.select("doc_id", "crc32"), "doc_id")


# formats, signals, generators
def signed_files(spark, sf_dir):
    """Every text behind the first bytes of a format by id; every 50th is empty."""
    content = F.concat(F.unhex(pick(F.col("doc_id"), SIGNATURES)), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    content = F.when(F.pmod("doc_id", F.lit(50)) == 13, F.unhex(F.lit(""))).otherwise(content)
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content")).withColumn("format", detect_format(F.col("content")))


def detect_formats(spark, sf_dir):
    return signed_files(spark, sf_dir).select("doc_id", "format", error_code(F.octet_length("content"), F.col("format"), [f[0] for f in dims.FORMATS]).alias("error"))


def format_registry(spark, sf_dir):
    """What the registry says of each format, and how many files are of it; of those that it doesn't know too."""
    known = dims.formats(spark).filter("support <> 'none'")
    return signed_files(spark, sf_dir).groupBy("format").agg(F.count("*").alias("files")).join(F.broadcast(known), "format", "left")


def signal_verdicts(spark, sf_dir):
    """How many files have each signal in which status, by what can be done about it."""
    spec = dims.signals(spark).select("signal_id", "category", "axis", dims.verdict(F.col("detect"), F.col("remove"), F.col("verify")).alias("verdict"))
    return made_facts(spark, sf_dir).join(F.broadcast(spec), "signal_id").groupBy("signal_id", "category", "axis", "verdict", "status").agg(F.count("*").alias("files"))


def presets_valid(spark, sf_dir):
    """Of the detected signals, how many each preset would take out; all of its blocks must be removable."""
    blocks = dims.presets(spark).select("preset", F.explode("blocks").alias("signal_id")).join(dims.signals(spark).select("signal_id", "remove"), "signal_id")
    found = made_facts(spark, sf_dir).filter("status = 'detected'").groupBy("signal_id").agg(F.count("*").alias("files"))
    return blocks.join(found, "signal_id", "left").groupBy("preset").agg(F.count("*").alias("blocks"), F.bool_and("remove").alias("removable"), F.sum(F.coalesce("files", F.lit(0))).alias("signals"))


def generator_match(spark, sf_dir):
    needles = dims.GENERATOR_NEEDLES
    rows = table(spark, sf_dir, "documents").select("doc_id", needles.hits(F.col("text")).alias("hits")).filter("size(hits) > 0")
    return rows.select("doc_id", needles.first_of(F.col("hits")).alias("generator"), F.array_join("hits", ",").alias("needles"))


def png_keys(spark, sf_dir):
    """Keywords by id, and the generator that each gives away."""
    key = pick(F.col("doc_id"), [*dims.PNG_KEYS, "Title"])
    return table(spark, sf_dir, "documents").select(key.alias("key")).groupBy("key").agg(F.count("*").alias("files")).withColumn("generator", dims.png_generator(F.col("key")))


# markup
def fm_keys(spark, sf_dir):
    return markup.front_matter_keys(markdown_documents(spark, sf_dir), "doc_id", "md").drop("path").withColumn("last", F.col("last").cast("long"))


def fm_clean(spark, sf_dir):
    return markup.clean_front_matter(markdown_documents(spark, sf_dir), "doc_id", "md").select("doc_id", F.md5("cleaned").alias("cleaned"))


def html_comments(spark, sf_dir):
    p = marked_pages(spark, sf_dir)
    return p.select("page_id", F.size(markup.comments(F.col("html"), False)).alias("all_comments"), F.array_join(markup.comments(F.col("html")), "|").alias("told"))


def html_meta(spark, sf_dir):
    return marked_pages(spark, sf_dir).select("page_id", F.explode(markup.meta_tags(F.col("html"))).alias("m")).select("page_id", "m.*")


def html_json_ld(spark, sf_dir):
    return marked_pages(spark, sf_dir).select("page_id", F.array_join(markup.json_ld(F.col("html")), "|").alias("json_ld"))


def html_active(spark, sf_dir):
    p, html = marked_pages(spark, sf_dir), F.col("html")
    return p.select("page_id", markup.event_handlers(html).alias("handlers"), F.size(markup.remote_references(html)).alias("remote"))


# facts
def made_facts(spark, sf_dir, shift=0):
    """Statuses of every signal for every document, by its id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")).crossJoin(F.broadcast(dims.signals(spark)))
    state = F.pmod(F.col("item_id") * 7 + F.col("ord") * 3 + shift, F.lit(5))
    status = F.when(~F.col("verify") & ~F.col("detect"), "unable_to_verify").when(state < 2, "detected").otherwise("not_detected")
    return d.select("item_id", "signal_id", status.alias("status"), "ord")


def compare_outcomes(spark, sf_dir):
    after = made_facts(spark, sf_dir, 2).filter("(item_id + ord) % 13 <> 0").drop("ord")
    out = compare(made_facts(spark, sf_dir).drop("ord"), after, blocks=["exif", "xmp"], kept_orientation=F.pmod("item_id", F.lit(2)) == 0)
    return out.groupBy("signal_id", "before_status", "after_status", "outcome").agg(F.count("*").alias("n"))


def exposure_axes(spark, sf_dir):
    return exposure(made_facts(spark, sf_dir).drop("ord"))


# image containers
def made_jpegs(spark, sf_dir):
    """A small JPEG for every document, with a comment, EXIF or ICC segment by its id and the whole text as scan."""
    add = lambda n, marker, data: F.when(F.pmod("doc_id", F.lit(n)) == 0, F.unhex(F.lit(f"FF{marker}{len(data) + 2:04X}{data.hex()}"))).otherwise(F.unhex(F.lit("")))
    parts = [F.unhex(F.lit("FFD8")), add(5, "E2", b"ICC_PROFILE\0x"), add(3, "E1", b"Exif\0\0stuff"), add(2, "FE", b"a note"), F.unhex(F.lit("FFDA0002")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("FFD9000000000000"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("content"))


def image_clean_verify(spark, sf_dir):
    return clean_and_verify_images(made_jpegs(spark, sf_dir), "doc_id", "content").groupBy("signal_id", "before_status", "after_status", "outcome").agg(F.count("*").alias("n"))


# audit
def audit_tallies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *audit.tally(F.col("value") > 100, "large"), *audit.tally(F.col("user_id") % 7 == 0, "seventh"))


def audit_quantiles(spark, sf_dir):
    return audit.rank_quantiles(table(spark, sf_dir, "events"), "value", ["event_type"], [0.5, 0.95])


def audit_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return audit.histogram(e, F.concat(F.col("event_type"), F.lit(" at offset "), F.col("user_id").cast("string")))


def audit_gate(spark, sf_dir):
    return audit.gate(table(spark, sf_dir, "events"), F.pmod("event_id", F.lit(12)) == 0)


def count_buckets(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("c"))
    return per.groupBy(T.count_bucket(F.col("c")).alias("bucket")).agg(F.count("*").alias("users"))


# lint
def lint_documents(spark, sf_dir):
    return lint(markdown_documents(spark, sf_dir), "doc_id", "md").groupBy("level", "rule").agg(F.count("*").alias("n"))


def lint_duplicates(spark, sf_dir):
    return duplicate_titles(table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title")), "doc_id", "title")


def lint_summary(spark, sf_dir):
    return lint_totals(lint(markdown_documents(spark, sf_dir), "doc_id", "md"), "doc_id")


# limiter
def limiter_fixed_bucket(spark, sf_dir):
    out = limiter.fixed_buckets(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), [(3600, 2), (86400, 10)], "event_type", "ts", "event_id")
    return out.select("event_id", "admitted", "denied_by")


def limiter_sliding(spark, sf_dir):
    return limiter.sliding_log(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), [(3600, 2), (86400, 10)], "event_type", "ts", "event_id")


# graphs and versions
def revision_overlay(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.pmod("o_orderkey", F.lit(5)).alias("obj"), F.pmod(F.col("o_orderkey") * 7919, F.lit(1_000_003)).alias("rev"))
    return graph.overlay(o, "o_custkey", "obj", "rev", at_least=1000).select("o_custkey", "obj", "rev", "o_orderkey")


def reachability(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").cast("long").alias("src"), F.pmod(F.col("n_nationkey") * 2 + 1, F.lit(25)).cast("long").alias("dst"))
    return graph.reachable(spark, edges, n.filter("n_nationkey = 3").select(F.col("n_nationkey").cast("long").alias("node")))


def renumber_offsets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.pmod("o_orderkey", F.lit(97)).alias("len"))
    return graph.renumber(o, "o_custkey", "o_orderkey", "len").drop("len")


def interval_apply(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(17)).cast("int")
    edits = F.array(F.struct((k + 2).alias("start"), (k + 9).alias("end")), F.struct((k + 5).alias("start"), (k + 30).alias("end")), F.struct((k + 9).alias("start"), (k + 12).alias("end")))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(graph.apply_deletions(d, "text", edits)).alias("left_over"))


def related_links(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") * 2, F.col("p_partkey") - 1)).alias("pos", "to"))
    other = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("to"), F.col("p_name").alias("title"))
    return p.join(other, "to").select("p_partkey", "pos", "title")


QUERIES = {f.__name__: f for f in (
    hidden_scan, hidden_findings, hidden_clean, hidden_runs, text_clean_verify, sanitize_values, filename_ops, size_format, strip_tags, word_numbers, digests,
    detect_formats, format_registry, signal_verdicts, presets_valid, generator_match, png_keys, fm_keys, fm_clean, html_comments, html_meta, html_json_ld, html_active,
    compare_outcomes, exposure_axes, image_clean_verify, audit_tallies, audit_quantiles, audit_histogram, audit_gate, count_buckets, lint_documents, lint_duplicates, lint_summary,
    limiter_fixed_bucket, limiter_sliding, revision_overlay, reachability, renumber_offsets, interval_apply, related_links,
)}
