"""The registered queries over scans of files of any format."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.workspace import Workspace

from ..functions import texts as T
from ..functions import values
from ..functions.tables import register_table_functions
from ..operators import documents, guides, markup, rollups, svg
from . import dims, made
from .queries import made_facts, table


def files(spark, sf_dir, content):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), content.alias("content"))


def svg_signals(spark, sf_dir):
    """Signals of SVG files, a third of which hold a JPEG."""
    return documents.scan_files(files(spark, sf_dir, made.carrier(F.col("doc_id")))).drop("format", "reason")


def markdown_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", made.signed_guide(F.col("doc_id")).alias("text"))
    return documents.markdown_signals(rows, "doc_id")


def files_scan(spark, sf_dir):
    """Every document as one of seven kinds of file by id; how many files have which signal, or which reason not to be read."""
    i = F.col("doc_id")
    kind = F.pmod(i, F.lit(7))
    content = F.when(kind == 0, made.refused_svg(i)).when(kind == 1, made.png(i)).when(kind == 2, made.carrier(i)).when(kind == 3, made.utf8(made.signed_guide(i))).when(kind == 4, made.webp(i)).when(kind == 5, made.jpeg(i)).otherwise(made.raw(b"GIF89a" + bytes(9)))
    return documents.scan_files(files(spark, sf_dir, content)).groupBy("format", "signal_id", "status", "reason").agg(F.count("*").alias("files"))


def svg_refusals(spark, sf_dir):
    """Why SVG files are not read."""
    rows = svg.clean_svg(files(spark, sf_dir, made.refused_svg(F.col("doc_id"))))
    return rows.select("item_id", "reason", F.col("cleaned").isNull().alias("left_alone"))


QUERIES = {f.__name__: f for f in (svg_signals, markdown_signals, files_scan, svg_refusals)}


def segments_sql(spark, sf_dir):
    """The parts of JPEG and PNG files by table functions in SQL."""
    register_table_functions(spark)
    i = F.col("doc_id")
    images = table(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod(i, F.lit(2)) == 0, made.jpeg(i)).otherwise(made.png(i)).alias("content"))
    return spark.sql(
        """WITH parts AS (
             SELECT doc_id, 'jpeg' AS kind, p.* FROM {images}, LATERAL jpeg_segments(content) p WHERE doc_id % 2 = 0
             UNION ALL SELECT doc_id, 'png', p.* FROM {images}, LATERAL png_chunks(content) p WHERE doc_id % 2 = 1)
           SELECT doc_id, kind, count(*) AS parts, array_join(transform(array_sort(collect_list(struct(start, tag))), x -> x.tag), ' ') AS tags
           FROM parts GROUP BY doc_id, kind""",
        images=images,
    )


def rollup_documents(spark, sf_dir):
    words = T.word_number(F.col("text")).cast("long")
    return rollups.rolled_up(table(spark, sf_dir, "documents").select("source", "lang", words.alias("words")), ["source", "lang"], F.count("*").alias("documents"), F.sum("words").alias("words"))


def cube_statuses(spark, sf_dir):
    facts = made_facts(spark, sf_dir).join(F.broadcast(dims.signals(spark).select("signal_id", "axis")), "signal_id")
    return rollups.cubed(facts, ["axis", "status"], F.count("*").alias("facts"))


def distinct_users(spark, sf_dir):
    """Distinct users by month from sketches by day, beside the exact count; close: within three standard errors."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = Workspace(spark).save(rollups.distinct_sketches(events, ["day"], "user_id"))
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    estimated = rollups.merged_counts(days, [month("day")])
    exact = events.groupBy(month("ts")).agg(F.countDistinct("user_id").alias("users"))
    error = 3 * 1.04 / 2 ** (rollups.LG / 2)
    return exact.join(estimated, "month").select("month", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1), F.col("users") * error)).alias("close"))


def front_matter_json(spark, sf_dir):
    """Each guide's top-level values as one JSON object with types, and printed for people."""
    made_guides = table(spark, sf_dir, "documents").select("doc_id", made.typed_guide(F.col("doc_id")).alias("md"))
    keys = F.filter(markup.entries(markup.front_matter(F.col("md"))), lambda k: k["indent"] == 0)
    value = lambda k: values.typed_value(guides.scalar(k["value"]))
    rows = made_guides.select("doc_id", F.transform(keys, lambda k: F.struct(k["name"].alias("key"), F.to_json(value(k)).alias("json"))).alias("entries"))
    shown = values.pretty_json(values.json_object(F.col("entries")))
    kinds = F.array_join(F.transform("entries", lambda e: F.regexp_extract(F.schema_of_variant(F.parse_json(e["json"])), r"\A\w+", 0)), ",")
    return rows.select("doc_id", shown.alias("preview"), kinds.alias("kinds"))


QUERIES |= {f.__name__: f for f in (segments_sql, rollup_documents, cube_statuses, distinct_users, front_matter_json)}
