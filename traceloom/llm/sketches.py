"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import MANY, Workspace, buckets, whole_text

#: Cells in each of the three parts of a fingerprint: 24 cells, enough for about 16 differences.
WIDTH = 8
#: Cells in each part of the larger sketches, and the first bit of a digest that places it in them.
LARGER = ((8, 9), (16, 18), (32, 24))
#: Paragraphs of a text that one region of a larger sketch holds on average.
REGION = 6
#: Texts of more paragraphs get a row of their own for each region.
LONG = 6144
#: Rounds of peeling; each empties all cells that hold one digest.
ROUNDS = 12
#: Documents of a bucket, within which the next document is found; quantiles of the ids that bound buckets.
NEIGHBOURS, QUANTILES = 64, 256


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the text's paragraphs: what lies between line ends, sentence ends and table bars."""
    parts = F.split(text, r"[.!?|\n]\s*")
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _parts(width: int, bit: int, cell) -> Column:
    """An array of the cells of all three parts: cell(placed, i), where placed(digest) tells if a digest lies in it."""
    step = width.bit_length() - 1

    def part(t):
        def at(place):
            return cell(lambda d: F.shiftrightunsigned(d, bit + t * step).bitwiseAND(F.lit(width - 1).cast("long")) == place, place.cast("int") + t * width)

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), at)

    return F.concat(*[part(t) for t in range(3)])


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.alias("k"), h.alias("h"))


def sketch(found: Column, width: int = WIDTH, bit: int = 0) -> Column:
    """Cells (count, xor of digests, xor of their hashes), three for each digest, one in each part."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda s, d: _cell(s["c"] + 1, s["k"].bitwiseXOR(d), s["h"].bitwiseXOR(F.xxhash64(d)))
    return _parts(width, bit, lambda placed, _: F.aggregate(F.filter(found, placed), zero, add))


def subtract(one: Column, two: Column) -> Column:
    """Cell by cell; what both sketches hold cancels out."""
    return F.zip_with(one, two, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column, width: int = WIDTH, bit: int = 0) -> Column:
    """The digests in a difference of sketches, found by peeling; null if some cells don't empty.

    Steps alternate: one finds the cells that hold a single digest, the next takes these digests out
    of all their cells. Where there are none to take out, this and all later steps do nothing.
    """
    kind = "array<struct<c:int,k:bigint,h:bigint>>"
    none = F.array().cast(kind)

    def state(cells, pure, got, live):
        return F.struct(cells.alias("cells"), pure.alias("pure"), got.alias("got"), live.alias("live"))

    def find(s):
        pure = F.array_distinct(F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == F.xxhash64(x["k"]))))
        return state(s["cells"], pure, s["got"], s["live"])

    stop = lambda s: state(s["cells"], s["pure"], s["got"], F.lit(False))

    def clear(s):
        take = lambda y, p: _cell(y["c"] - p["c"], y["k"].bitwiseXOR(p["k"]), y["h"].bitwiseXOR(p["h"]))
        cleared = _parts(width, bit, lambda placed, i: F.aggregate(F.filter(s["pure"], lambda p: placed(p["k"])), F.get(s["cells"], i), take))
        return state(cleared, none, F.concat(s["got"], F.transform(s["pure"], lambda p: p["k"])), s["live"])

    start = state(cells, none, F.array().cast("array<bigint>"), F.lit(True))
    step = lambda s, n: F.when(~s["live"], s).when(n % 2 == 1, find(s)).when(F.size(s["pure"]) == 0, stop(s)).otherwise(clear(s))
    empty = lambda s: ~F.exists(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start, step, lambda s: F.when(empty(s), s["got"]))


def as_text(cells: Column) -> Column:
    """The fingerprint: eight, sixteen and sixteen hex digits for each cell, all that subtracting and peeling need."""
    one = lambda x: F.concat(F.lpad(F.hex(x["c"].cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"]), 16, "0"))
    return F.lower(F.array_join(F.transform(cells, one), ""))


def differences(sets: Column, others: list[str], wanted: dict[str, Column] | None = None) -> Column:
    """sets is a struct of small lists: how many digests only one of its a and each of others holds.

    Where `wanted` of a list is false, it is not compared, and its number is 0.

    From larger and larger sketches, until one peels. If the largest fails too, which digests alike in
    all their places would take, the lists are compared. Sketches of the first size are made once.
    """
    w, b = LARGER[0]
    asked = lambda x, c: F.when(wanted[x], c) if wanted and x in wanted else c
    first = F.transform(F.array(sets), lambda s: F.struct(*[s[x].alias(x) for x in ["a", *others]], *[asked(x, sketch(s[x], w, b)).alias(f"s{x}") for x in ["a", *others]]))

    def one(s, x):
        tries = [F.array_size(peel(subtract(s["sa"], s[f"s{x}"]), w, b))]
        tries += [F.array_size(peel(subtract(sketch(s["a"], w, b), sketch(s[x], w, b)), w, b)) for w, b in LARGER[1:]]
        return F.coalesce(*tries, F.size(F.array_except(s["a"], s[x])) + F.size(F.array_except(s[x], s["a"])))

    return F.transform(first, lambda s: F.struct(*[F.coalesce(asked(x, one(s, x)), F.lit(0)).alias(x) for x in others]))[0]


def _split(regions: Column, bit: int, parts: int) -> Column:
    """Each region (a struct of lists a, e, n) in two or four, by one or two bits of the digests."""
    most = F.lit(parts - 1).cast("long")
    part = lambda s, r: F.struct(*[F.filter(s[x], lambda d: F.shiftrightunsigned(d, bit).bitwiseAND(most) == r).alias(x) for x in "aen"])
    return F.flatten(F.transform(regions, lambda s: F.transform(F.sequence(F.lit(0).cast("long"), most), lambda r: part(s, r))))


def _regions(most: Column) -> Column:
    """The power of two that leaves about REGION digests a region."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), most / REGION)))).cast("long")


def _region(digest: Column, regions: Column) -> Column:
    return F.shiftrightunsigned(digest, 40).bitwiseAND(regions - 1)


def likeness(one: Column, two: Column, differing: Column) -> Column:
    """Shared paragraphs' part of all, from the sizes of two sets and of their difference; 1 for two empty sets."""
    return F.when(one + two == 0, F.lit(1.0)).otherwise((one + two - differing) / (one + two + differing)).cast("double")


def neighbours():
    """The order of documents within a bucket."""
    return Window.partitionBy("bucket").orderBy("tail", F.desc_nulls_last("doc_id"), F.desc("mark"), F.desc("text"))


def id_buckets(rows: DataFrame) -> Column:
    """A bucket number that rises with doc_id, with about NEIGHBOURS rows each.

    The ids' quantiles bound QUANTILES ranges of about as many rows, and each range is cut into equal
    widths; so far outliers and dense spots spoil no more than their own range. Rows without an id
    follow below all others, by ranges of their mark, and so do within its place the rows of an id that
    very many have: more than one in MANY rows, so fewer than MANY ids.
    """
    quantiles = F.percentile_approx("doc_id", [k / QUANTILES for k in range(1, QUANTILES)], 100 * QUANTILES)
    low, high, count, known, cuts = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.count("doc_id"), quantiles).first()
    nulls = buckets(count - known, NEIGHBOURS)
    unknown = F.floor(F.shiftrightunsigned("mark", 47) * F.lit(nulls) / F.lit(1 << 16)).cast("long") - nulls
    if not known:
        return unknown
    lows = sorted({low, *cuts})
    each = -(-buckets(known, NEIGHBOURS) // len(lows))
    widths = [max(1, -(-(after - first) // each)) for first, after in zip(lows, [*lows[1:], high + 1])]
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    at = F.size(F.filter(listed(lows[1:], "bigint"), lambda x: x <= F.col("doc_id"))) if lows[1:] else F.lit(0)
    of = lambda values: F.element_at(listed(values, "decimal(20,0)"), at + 1)
    inside = F.floor((F.col("doc_id").cast("decimal(20,0)") - of(lows)) / of(widths)).cast("long")
    plain = F.when(F.col("doc_id").isNull(), unknown).otherwise(at.cast("long") * each + inside)
    often = rows.groupBy("doc_id").count().filter(F.col("doc_id").isNotNull() & (F.col("count") > max(2 * NEIGHBOURS, count // MANY)))
    hot = dict(sorted((r["doc_id"], buckets(r["count"], NEIGHBOURS)) for r in often.collect()))
    if not hot:
        return plain
    # after the bucket come the place among the hot ids (even between two, odd at one) and the range of the mark
    below = F.size(F.filter(listed(hot, "bigint"), lambda x: x < F.col("doc_id")))
    own = F.array_contains(listed(hot, "bigint"), F.col("doc_id"))
    ranges = F.get(listed(hot.values(), "bigint"), below)
    part = F.floor(F.shiftrightunsigned("mark", 47) * ranges / F.lit(1 << 16)).cast("long")
    finer = F.when(own, ((2 * below + 1) * (1 << 16)).cast("long") + part).otherwise((2 * below * (1 << 16)).cast("long"))
    return plain * (1 << 32) + F.coalesce(finer, F.lit(0).cast("long"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next (the text of the next document by falling doc_id; after the last comes the first), bucket, place, tail.

    Texts are shuffled once, by buckets of ids. The first document of each bucket (found by a join
    with the buckets, 65536 or little more) also goes to the bucket that it follows, as a row with tail 1 and no next. Equal
    ids follow by falling hash of their texts; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 1))
    rows = rows.withColumn("bucket", id_buckets(rows))
    bare = Workspace(spark).save(rows.select("doc_id", "mark", "bucket"))
    there = bare.select("bucket").distinct()
    whole = Window.partitionBy(F.lit(1))
    to = there.withColumn("to", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(whole)))
    top = bare.groupBy("bucket").agg(F.max(F.struct("doc_id", "mark")).alias("top")).join(to, "bucket").select("bucket", "top", "to")
    is_top = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("mark") == F.col("top.mark"))
    first = rows.join(F.broadcast(top), "bucket").filter(is_top).groupBy("to").agg(F.max(F.struct("doc_id", "mark", "text")).alias("head"))
    heads = first.select("head.doc_id", "head.text", "head.mark", F.col("to").alias("bucket"), F.lit(1).alias("tail"))
    every = rows.withColumn("tail", F.lit(0)).unionByName(heads)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes don't mean few tasks: the work is in the sketches
    return every.repartition(parts, "bucket").withColumn("next", F.lead("text").over(neighbours())).withColumn("place", F.row_number().over(neighbours()))


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and how alike they are.

    The edited text keeps all but the last floor(n_chars/2) code points, which the first as many of the
    next document replace (all it has, if fewer). Fingerprints are sketches of 24 cells; their difference
    is peeled. Where that fails, larger sketches are tried, by regions of the digests' range, so that
    the work grows in proportion to a text's paragraphs; texts of very many get their regions dealt out.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next:
    the fingerprint holds all 24 cells whole, so whatever peels can be peeled again from two of them.
    Null and empty texts have no paragraphs; two such are alike (1). A single document is followed by
    itself. Repeated rows each have a row; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next", F.lit(1), half)))
    rows = rows.select("bucket", "place", "tail", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"))
    rows = rows.withColumn("sa", sketch(F.col("a"))).withColumn("se", sketch(F.col("e")))
    after = Window.partitionBy("bucket").orderBy("place")
    rows = rows.withColumn("n", F.lead("a").over(after)).withColumn("sn", F.lead("sa").over(after)).filter("tail = 0")
    rows = rows.withColumn("most", F.greatest(F.size("a"), F.size("e"), F.size("n")))
    for side in "en":
        rows = rows.withColumn(f"d{side}", F.array_size(peel(subtract(F.col("sa"), F.col(f"s{side}")))))
    regions, most = F.array(F.struct("a", "e", "n")), REGION
    choice = F.when(F.col("most") <= most, regions)
    for level in range(5):  # 2, 4, 8, ... regions
        choice = choice.when(F.col("most") <= 2 * most, _split(regions, 40 + 2 * level, 2))
        regions, most = _split(regions, 40 + 2 * level, 4), 4 * most
        choice = choice.when(F.col("most") <= most, regions)
    unsure = (F.col("most") <= LONG) & (F.col("de").isNull() | F.col("dn").isNull())
    rows = rows.withColumn("regions", F.when(unsure, choice))
    found = F.aggregate(F.transform("regions", lambda r: differences(r, ["e", "n"], {x: F.col(f"d{x}").isNull() for x in "en"})), F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")), lambda t, d: F.struct((t["e"] + d["e"]).alias("e"), (t["n"] + d["n"]).alias("n")))
    rows = rows.withColumn("found", F.when(unsure, found))
    for side in "en":
        rows = rows.withColumn(f"d{side}", F.coalesce(f"d{side}", F.col("found")[side]))
    left = F.col("de").isNull() | F.col("dn").isNull()
    rows = rows.select("bucket", "place", "doc_id", "n_chars", "edited_sha256", as_text(F.col("sa")).alias("fingerprint"), as_text(F.col("se")).alias("edited_fingerprint"), "de", "dn", *[F.size(x).alias(f"n_{x}") for x in "aen"], *[F.when(left, F.col(x)).alias(x) for x in "aen"])
    rows = ws.save(rows)
    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("n_a"), F.col("n_e"), F.col("de")).alias("near_edited"), likeness(F.col("n_a"), F.col("n_n"), F.col("dn")).alias("near_next")]
    long = rows.filter(left)
    entry = F.concat(*[F.transform(x, lambda d: F.struct(F.lit(x).alias("side"), d.alias("d"))) for x in "aen"])
    dealt = long.select("bucket", "place", _regions(F.greatest("n_a", "n_e", "n_n")).alias("r"), F.explode(entry).alias("x")).groupBy("bucket", "place", _region(F.col("x.d"), F.col("r")).alias("region"))
    lists = dealt.agg(*[F.collect_list(F.when(F.col("x.side") == x, F.col("x.d"))).alias(x) for x in "aen"])
    found = lists.select("bucket", "place", differences(F.struct("a", "e", "n"), ["e", "n"]).alias("d")).select("bucket", "place", F.col("d.e").alias("de"), F.col("d.n").alias("dn")).groupBy("bucket", "place").agg(F.sum("de").alias("de"), F.sum("dn").alias("dn"))
    return rows.filter(~left).select(*result).union(long.drop("de", "dn").join(found, ["bucket", "place"]).select(*result))
