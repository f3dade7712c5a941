"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, buckets, whole_text

#: Words of a block, where none is given: exact to the word, at the cost of a row a word that is taken once more.
BLOCK_WORDS = 1
#: Blocks in a shard of a source; the seeded choice runs within shards.
SHARD_BLOCKS = 4096
#: Rows of a bucket of a source, whose order one task finds.
ORDERED = 256
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources(skey, source_size): adds target, the words wanted of each source.

    Sources in order of skey weigh `weights`, repeating; together they get share times all words, but
    none more than cap times its own, and what exceeds that goes to the others by weight. With the
    sources in order of cap to weight, those below the common level are capped, all others get level
    times weight; the level is the first that no later source exceeds. The windows run over the
    sources, not their documents.
    """
    order = Window.orderBy("skey")
    by_ratio = Window.orderBy("_ratio", "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(cap))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    )
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "skey", "_level"))).over(everything)
    return ranked.withColumn("_at", level["_level"]).select("skey", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_at") * F.col("_w")), F.col("_cap")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, limit: str, limited: bool = True) -> DataFrame:
    """Seats by highest quotients votes / (2s - 1), for each group; a party gets `limit` at most.

    parties has one row a party; `seats` (the same in a group) are given out. Adds _seats. All seats
    are votes / divisor, rounded, so the divisor's inverse lies within half a seat a party of seats /
    votes. Every party surely gets `_low` and at most `_high` seats by these bounds, and only the
    quotients between are ranked: about two a party, however many parties and seats there are. Where
    limits bind for some parties (`limited`), others get more: the bound then grows by the number of
    parties, which must be small. Limits that are the same part of all votes don't bind before
    all seats are given. Ties go to the smaller party value.
    """
    all_ = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    total, count = F.sum(votes).over(all_), F.count("*").over(all_)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    low = F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col(seats) - F.col("_count") / 2)) - 1)
    bound = parties.withColumn("_count", count).withColumn("_share", share).withColumn("_low", F.least(low.cast("long"), F.col(limit).cast("long")))
    high = F.ceil(F.col("_share") * (F.col(seats) + F.col("_count") / 2)) + 1 + (F.col("_count") if limited else 0)
    bound = bound.withColumn("_high", F.least(high.cast("long"), F.col(limit).cast("long"))).withColumn("_rest", F.col(seats).cast("long") - F.sum("_low").over(all_))
    quotients = bound.withColumn("_s", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array().cast("array<bigint>"))))
    rank = F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(F.desc(F.col(votes) / (2 * F.col("_s") - 1)), party, "_s"))
    won = quotients.withColumn("_rank", rank).filter((F.col("_rank") <= F.col("_rest")) & (F.col(votes) > 0)).groupBy(*group, party).agg(F.count("*").alias("_won"))
    return bound.join(won, [*group, party], "left").withColumn("_seats", F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).drop("_count", "_share", "_low", "_high", "_rest", "_won")


def seeded(seed: int, *parts: Column) -> Column:
    """60 bits of an MD5 of the seed and some text: an order that any engine can find again."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def source_key(source_col: str) -> Column:
    """The source as a value that sorts in code-point order, null last."""
    return F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))


def source_quotas(sources: DataFrame, block: int, cap: float) -> DataFrame:
    """skey, _blocks, and the blocks that a source gives: all of them _whole times, and _extra of them once more."""
    blocks = F.ceil(F.col("source_size") / block)
    wanted = F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block).cast("long")
    quota = sainte_lague(sources.withColumn("_blocks", blocks).withColumn("_all", wanted).withColumn("_most", F.floor(F.col("_blocks") * cap)), [], "skey", "target", "_all", "_most")
    return quota.filter("_blocks > 0").select("skey", "_blocks", F.floor(F.col("_seats") / F.col("_blocks")).alias("_whole"), F.pmod("_seats", "_blocks").alias("_extra"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mix takes, when sources are brought to their targets.

    The words of a source form a stream, its documents in seeded order, cut into blocks of `block`
    words; a source misses its target by a block or two at most, so the larger the sources, the larger
    blocks may be. Sainte-Lague gives each source its blocks, and the shards of a source their part
    of these; a shard takes the blocks with the lowest seeded hashes. A source that is to give more
    than it has gives every block once and the chosen ones twice.
    Returns doc_id, size, source_size, target, taken. Null texts have size 0; a null source is a
    source of its own, the last; documents without words take 0. Repeated rows are separate
    documents. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    skey = source_key(source_col)
    key = seeded(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")), whole_text(text_col))
    rows = ws.save(docs.select(F.col(id_col).alias("doc_id"), skey.alias("skey"), word_count(whole_text(text_col)).alias("size"), key.alias("_key")))
    count = rows.count()
    sources = source_targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = ws.save(sources)
    quota = ws.save(source_quotas(sources, block, cap))
    # shards for each source, and their quotas of the blocks that are taken once more
    shard = quota.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_blocks") - 1) / SHARD_BLOCKS))))
    shard = shard.withColumn("_in", F.least(F.lit(SHARD_BLOCKS).cast("long"), F.col("_blocks") - F.col("_shard") * SHARD_BLOCKS))
    shard = sainte_lague(shard, ["skey"], "_shard", "_in", "_extra", "_in", limited=False)
    # spread by hand, and stored: a few rows become very many, which neither their size now nor a planner's guess tells
    spread = quota.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0] // (64 * SHARD_BLOCKS)
    shard = shard.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(65536, spread)), "skey", "_shard")
    block_no = shard.withColumn("_block", F.explode(F.sequence(F.col("_shard") * SHARD_BLOCKS, F.col("_shard") * SHARD_BLOCKS + F.col("_in") - 1)))
    chance = Window.partitionBy("skey", "_shard").orderBy(seeded(seed, F.col("skey"), F.col("_block").cast("string")), "_block")
    chosen = ws.save(block_no.withColumn("_rank", F.row_number().over(chance)).filter("_rank <= _seats").select("skey", "_block"))
    # places of documents in the stream of their source
    bucket = F.pmod("_key", F.lit(buckets(count, ORDERED)))
    full = rows.filter("size > 0").withColumn("_bucket", bucket)
    before = Window.partitionBy("skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = full.groupBy("skey", "_bucket").agg(F.sum("size").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("skey", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.join(offset, ["skey", "_bucket"]).withColumn("_start", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).select("doc_id", "skey", "size", "_start")
    placed = ws.save(placed)
    end = F.col("_start") + F.col("size")
    parts = placed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((end - 1) / block))))
    words = F.least(end, (F.col("_block") + 1) * block) - F.greatest(F.col("_start"), F.col("_block") * block)
    extra = parts.join(chosen, ["skey", "_block"]).groupBy("skey", "_start").agg(F.sum(words).alias("_more"))
    taken = placed.join(extra, ["skey", "_start"], "left").select("doc_id", "skey", "size", F.coalesce("_more", F.lit(0)).alias("_more"))
    result = taken.union(rows.filter("size = 0").select("doc_id", "skey", "size", F.lit(0).cast("long")))
    whole = sources.join(quota.select("skey", "_whole"), "skey", "left")
    return result.join(whole, "skey").select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("_whole", F.lit(0)) + F.col("_more")).cast("long").alias("taken"))


def mix_whole(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as a mix of whole documents takes it.

    Sources have the quotas of mix(). Every document comes as often as all blocks of its source do;
    of the source's documents in seeded order, those up to its quota of further words come once more. The
    document across that quota comes if half of it lies below, so a source misses its quota by half of
    one document at most. Documents without words don't come. Repeated rows and ids are separate documents.
    """
    ws = Workspace(docs.sparkSession)
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text_col)
    rows = docs.withColumns({"_skey": source_key(source_col), "_size": word_count(whole_text(text_col)), "_key": key}).filter("_size > 0")
    rows = ws.save(rows)
    count = rows.count()
    sources = ws.save(source_targets(rows.groupBy(F.col("_skey").alias("skey")).agg(F.sum("_size").alias("source_size")), weights, share, cap))
    quota = ws.save(source_quotas(sources, block, cap)).select(F.col("skey").alias("_skey"), "_whole", (F.col("_extra") * block).alias("_words"))
    rows = rows.withColumn("_bucket", F.pmod("_key", F.lit(buckets(count, ORDERED))))
    before = Window.partitionBy("_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("_skey", "_bucket").agg(F.sum("_size").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_skey", "_bucket").orderBy("_key", id_col, "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(offset.join(quota, "_skey"), ["_skey", "_bucket"])
    copies = (F.col("_whole") + F.when(F.col("_offset") + F.col("_before") + F.col("_size") / 2 < F.col("_words"), 1).otherwise(0)).cast("int")
    taken = placed.withColumn("_copies", copies).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
