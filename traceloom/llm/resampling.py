"""Importance resampling towards a target distribution: hashed n-grams, gains by bucket, a Gumbel draw without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, ascii_lower, whole_text

#: Of the registered query: n-grams from 1 to this, buckets, least words, percent drawn, seed.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Runs of letters and digits, A to Z lower-cased; any character beyond ASCII counts as a letter."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def features(longest: int, buckets: int) -> Column:
    """The buckets of all n-grams of the column `words`, repeats included: CRC-32 of the words joined by a space, modulo `buckets`."""

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform("words", lambda w: (F.crc32(w) % buckets).cast("int"))
        joined = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(joined, lambda at: (F.crc32(F.array_join(F.slice("words", at, n), " ")) % buckets).cast("int"))

    return F.concat(*map(runs, range(1, longest + 1)))


def gains(ws: Workspace, raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: floor(1000 * log of the target's share over the raw share), each with one added. One row a bucket, so at most `buckets`.

    raw and target have a column `buckets`, arrays. Counts are added up before the shuffle, so a frequent n-gram is no hot key.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    both = counted(raw, "s").join(counted(target, "t"), "bucket", "full").join(raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")), "bucket", "right")
    both = ws.save(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * (all_s + buckets)).cast("double") / ((F.col("s") + 1) * (all_t + buckets)).cast("double")
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(doc_id: str | Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from 32 bits of sha256('seed:doc_id'); a null id stands as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is 1, 2, 3... for the drawn, else null.

    A document's weight is the mean gain of its n-grams, rounded down (none: 0). Of the N documents of `least_words`
    or more, floor(percent * N / 100) are drawn by highest score; ties go to the smaller doc_id, null last; rows of
    one id and one score in any order. A null text has no words. Empty tables give an empty result or gains of an
    empty target. Further columns are not read.

    The buckets of all texts are stored once; gains are one row a bucket, so they come by broadcast; sums are
    added up within the task that exploded the row. Ranks are a distributed sort's places: the place within a
    partition plus the rows of the partitions before it.
    """
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(whole_text(text_col)).alias("words"))
    rows = ws.save(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").alias("n_words"), features(longest, buckets).alias("buckets")))
    aim = target.select(words(whole_text(target_col)).alias("words")).select(features(longest, buckets).alias("buckets"))
    gain = gains(ws, rows, aim, buckets)

    each = rows.select("doc_id", "row", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    summed = each.join(F.broadcast(gain), "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    weighed = summed.withColumn("weight", F.expr("(sum - pmod(sum, greatest(n_features, 1))) div greatest(n_features, 1)"))
    weighed = weighed.select("doc_id", "row", "n_features", "weight", (F.col("weight") + gumbel("doc_id", seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))

    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = ws.save(ws.save(weighed).orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.expr("place & 8589934591")
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("eligible").cast("long")).alias("eligible_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the sort
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    drawn = F.floor(F.sum("eligible_rows").over(total) * int(percent) / 100)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), drawn.alias("drawn"))
    rank = F.col("offset") + within + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (rank <= F.col("drawn")), rank).alias("rank"))
