"""License scans by diagonal voting of word k-grams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import PHRASES, TEMPLATES
from .shared import ascii_lower, whole_text

#: Votes that a diagonal of a text must have, and how near diagonals of one passage are, with words put in or left out.
VOTES, NEIGHBOURS = 2, 4
#: Part of a template's words that a passage must hold in order, and its length against the template's at most.
COVERED, LONGER = 0.6, 1.5
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """label, base, at, grams (of the template), w0, w1, w2: every rolling k-gram, k = 3, or 2 for a phrase of two words (w2 null)."""
    rows = []
    for base, entries in ((True, phrases), (False, templates)):
        for label, text in entries:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            k = min(3, len(words))
            for at in range(len(words) - k + 1):
                gram = words[at : at + k] + [None] * (3 - k)
                rows.append((label, base, at, len(words) - k + 1, k, *gram))
    return spark.createDataFrame(rows, "label string, base boolean, at int, grams int, k int, w0 string, w1 string, w2 string").withColumn("hash", F.xxhash64("w0", "w1"))


def license_hits(docs: DataFrame, key: str, text_col: str, grams: DataFrame) -> DataFrame:
    """key, label, base, at, grams, k, place: every k-gram of every text that stands in a template, joined by rolling hash.

    The hash of two words finds the template's positions, the words themselves (and the third) decide.
    The templates are this module's fixed list, so they are broadcast.
    """
    words = F.filter(F.split(ascii_lower(whole_text(text_col)), WORD_GAP), lambda w: w != "")
    split = docs.select(key, words.alias("words"))
    runs = F.arrays_zip(F.col("words").alias("d0"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("d1"), F.slice("words", 3, F.greatest(F.size("words"), F.lit(1))).alias("d2"))
    rolled = split.select(key, F.posexplode(runs).alias("place", "g")).select(key, "place", "g.d0", "g.d1", "g.d2").withColumn("hash", F.xxhash64("d0", "d1"))
    same = (rolled["hash"] == grams["hash"]) & (F.col("d0") == F.col("w0")) & (F.col("d1") == F.col("w1")) & (F.col("w2").isNull() | (F.col("w2") == F.col("d2")))
    return rolled.join(F.broadcast(grams), same).select(key, "label", "base", "at", "grams", "k", "place")


def in_order(hits, k):
    """Words of a template that hits (place, at), sorted by place, cover in order; k words a hit."""
    start = F.struct(F.lit(-9).alias("place"), F.lit(-9).alias("at"), F.lit(0).alias("words"))

    def step(s, h):
        new = F.least(k, h["at"] - s["at"], h["place"] - s["place"])
        return F.when(new > 0, F.struct(h["place"].alias("place"), h["at"].alias("at"), (s["words"] + new).alias("words"))).otherwise(s)

    return F.aggregate(hits, start, step, lambda s: s["words"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Places of license phrases, passages of license texts and whole ones in every document.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. A k-gram at
    place p that stands at position t of a template votes for the diagonal p - t; diagonals of at least
    VOTES votes (one for a phrase) at most NEIGHBOURS apart are merged to a passage. It counts if its k-grams, read in order, cover at least
    COVERED of the template's words and it is at most LONGER times as long as the template. score is the
    largest part of a template so covered (1 for a phrase), 0 where nothing counts. Null and empty texts
    have no words, score 0 and empty labels. Repeated rows each have a row. An empty table gives no rows.
    """
    text = whole_text(text_col)
    # a row's key, so that copies of one text under many ids are no hot group
    key = F.unhex(F.md5(F.encode(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text), "UTF-8")))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("key"))
    hits = license_hits(keyed, "key", "text", template_grams(docs.sparkSession, phrases, templates))
    votes = hits.groupBy("key", "label", "base", "grams", "k", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    votes = votes.filter(F.col("base") | (F.size("at") >= VOTES))
    line = Window.partitionBy("key", "label", "base").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= F.when(F.col("base"), 0).otherwise(NEIGHBOURS), 0).otherwise(1)
    hit = F.transform("at", lambda a: F.struct((F.col("diagonal") + a).alias("place"), a.alias("at")))
    spans = votes.withColumn("step", step).withColumn("passage", F.sum("step").over(line)).withColumn("hits", hit)
    spans = spans.groupBy("key", "label", "base", "grams", "k", "passage").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    words = F.col("grams") + F.col("k") - 1
    start, end = F.col("hits")[0]["place"], F.element_at("hits", -1)["place"] + F.col("k")
    spans = spans.select("key", "label", "base", start.alias("start"), (in_order(F.col("hits"), F.col("k")) / words).alias("covered"), ((end - start) <= LONGER * words).alias("short"))
    spans = spans.filter((F.col("covered") >= COVERED) & F.col("short"))
    base = F.col("base")
    each = spans.groupBy("key").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"),
    )
    words = F.regexp_count(ascii_lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    counted = keyed.select("doc_id", words.alias("n_words"), "key")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return counted.join(each, "key", "left").select("doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
