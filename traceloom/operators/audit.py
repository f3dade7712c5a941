"""Corpus audit: tallies, ranks, histograms and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.workspace import Workspace


def tally(condition: Column, name: str) -> list[Column]:
    """Count and percentage (one decimal) of the rows that hold."""
    n = F.count_if(condition)
    return [n.alias(f"{name}_n"), F.when(F.count("*") > 0, F.round(100.0 * n / F.count("*"), 1)).otherwise(0.0).alias(f"{name}_pct")]


#: Splitters of a group, their accuracy, and values of a group that one task sorts.
SPLITTERS, ACCURACY, SORTED = 512, 20_000, 100_000


def rank_quantiles(rows: DataFrame, value: str, by: list[str], quantiles: list[float], most: int | None = None) -> DataFrame:
    """by, n, p50 (and so on for each quantile), most: the value at rank min(n - 1, floor(n q)) of each group, without interpolation.

    Nulls don't count; a group of nulls alone has no row. A null key is a group. Values are numbers or times.

    No group is sorted whole. Approximate splitters, from partial aggregates, enclose each wanted rank; an exact count
    tells how many values lie below and within; this is repeated on what lies within until a task can sort it (`most`,
    or SORTED), where equal values are one row. Splitters that missed the rank are seen by the count and not used.
    """
    ws = Workspace(rows.sparkSession)
    most = SORTED if most is None else most
    v = F.col(value)
    data = ws.save(rows.select(*by, value).filter(v.isNotNull()))
    numbers = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in enumerate(quantiles)]))
    state = data.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).withColumn("most", F.col("hi")).withColumn("wanted", numbers)
    rank = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("wanted.q")))
    state = ws.save(state.select(*by, "n", "most", F.col("wanted.k").alias("k"), rank.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("within"), F.lit(False).alias("stuck")))
    keys = [*by, "k"]

    def held(bounds: DataFrame, *columns: str) -> DataFrame:
        """The values of each group from lo to hi, with these columns of the bounds."""
        b = bounds.select(*[F.col(c).alias(f"_{c}") for c in by], "k", "lo", "hi", *columns)
        same = [F.col(f"_{c}").eqNullSafe(data[c]) for c in by]
        return data.join(b, [*same, v >= F.col("lo"), v <= F.col("hi")]).drop(*[f"_{c}" for c in by])

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_{c}" for c in keys})
        return left.join(right, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], how).drop(*[f"_{c}" for c in keys])

    while True:
        wide = (F.col("within") > most) & (F.col("lo") < F.col("hi")) & ~F.col("stuck")
        open_ = state.filter(wide)
        if open_.isEmpty():
            break
        grid = held(open_).groupBy(*keys).agg(F.percentile_approx(v, F.array(*[F.lit(i / SPLITTERS) for i in range(SPLITTERS + 1)]), ACCURACY).alias("splitters"))
        place = F.floor((F.col("rank") - F.col("below") + 0.5) / F.col("within") * SPLITTERS)
        near = meet(open_, grid, "inner").select(*keys, "lo", "hi", F.get("splitters", F.greatest(place - 1, F.lit(0)).cast("int")).alias("a"), F.get("splitters", F.least(place + 2, F.lit(SPLITTERS)).cast("int")).alias("b"))
        near = ws.save(near)
        found = held(near, "a", "b").groupBy(*keys).agg(F.count_if(v < F.col("a")).alias("less"), F.count_if(v.between(F.col("a"), F.col("b"))).alias("inner"))
        narrowed = meet(near.select(*keys, "a", "b"), found, "inner")
        both = meet(state, narrowed, "left")
        fits = (F.col("rank") - F.col("below") >= F.col("less")) & (F.col("rank") - F.col("below") < F.col("less") + F.col("inner")) & (F.col("inner") < F.col("within"))
        hit = F.coalesce(fits, F.lit(False))
        pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old)
        below = F.when(hit, F.col("below") + F.col("less")).otherwise(F.col("below")).alias("below")
        state = ws.save(both.select(*by, "n", "most", "k", "rank", pick("a", "lo"), pick("b", "hi"), below, pick("inner", "within"), (F.col("stuck") | (F.col("a").isNotNull() & ~hit)).alias("stuck")))
    counts = held(state, "rank", "below").groupBy(*keys, "rank", "below", value).count()
    upto = F.sum("count").over(Window.partitionBy(*keys).orderBy(value)) + F.col("below")
    answer = counts.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy(*keys).agg(F.min(v).alias("answer"))
    names = [f"p{round(q * 100)}" for q in quantiles]
    whole = meet(state, answer, "inner")
    return whole.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("answer"))).alias(name) for k, name in enumerate(names)], F.first("most").alias("most"))


def histogram(rows: DataFrame, label: Column) -> DataFrame:
    """How often each label occurs, its digits folded to N."""
    return rows.groupBy(F.regexp_replace(label, r"\d+", "N").alias("label")).agg(F.count("*").alias("n"))


def gate(rows: DataFrame, bad: Column, most: float = 0.10) -> DataFrame:
    share = F.count_if(bad) / F.count("*")
    return rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.when(share <= most, "pass").otherwise("fail").alias("verdict"))


# What a refusal says, in lower case, and its name; the first that fits counts.
REFUSALS = (
    ("encrypted", "encrypted"), ("cannot rebuild safely", "unsupported structure"), ("did not parse back", "output did not parse"), ("revisions rather than one", "output had extra revisions"),
    ("metadata survived", "metadata survived"), ("xmp packet survived", "xmp survived"), ("still present in the rebuilt", "value found in output bytes"),
)


def refusal(warnings: Column) -> Column:
    """The bucket of a refusal by its warnings (an array of texts)."""
    said, out = F.lower(F.array_join(warnings, " ")), F.lit("other")
    for words, name in reversed(REFUSALS):
        out = F.when(F.contains(said, F.lit(words)), name).otherwise(out)
    return out


def most_frequent(counts: DataFrame, n: str = "n", label: str = "label") -> DataFrame:
    """A histogram's rows, the most frequent first, ties by label."""
    return counts.orderBy(F.desc(n), label)


def preservation(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Of rows with digest arrays before and after (one a page): files, same number of pages, same contents, lost (no digests after)."""
    same = F.coalesce(F.size(before) == F.size(after), F.lit(False))
    return rows.agg(F.count("*").alias("files"), F.count_if(same).alias("same_pages"), F.count_if(F.col(before).eqNullSafe(F.col(after))).alias("same_contents"), F.count_if(F.col(after).isNull()).alias("lost"))


def percent(part: Column, whole: Column) -> Column:
    """12.3%, and 0.0% of nothing."""
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole)).otherwise("0.0%")


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """section, label, n, share: histograms (label, n) under each other, with each label's part of its section. Counts alone, no names or values of files."""
    rows = None
    for name, frame in sections.items():
        whole = frame.agg(F.sum("n").alias("whole"))
        part = frame.crossJoin(F.broadcast(whole)).select(F.lit(name).alias("section"), "label", "n", percent(F.col("n"), F.col("whole")).alias("share"))  # one row of whole
        rows = part if rows is None else rows.unionByName(part)
    return rows
