"""Ranks without sorting a group, and digests however the bytes are cut."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.functions.digests import chunks, digest, digest_of_chunks, power
from traceloom.operators import audit


def by_sorting(rows, quantiles):
    groups = {}
    for key, v in rows:
        if v is not None:
            groups.setdefault(key, []).append(v)
    return {k: (len(v), *[sorted(v)[min(len(v) - 1, int(len(v) * q))] for q in quantiles], max(v)) for k, v in groups.items()}


@pytest.mark.parametrize("most", [1, 20, 100_000])
def test_ranks_of_odd_groups(spark, most):
    rnd = random.Random(most)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(700)] + [("b", float(rnd.randrange(3))) for _ in range(300)] + [(None, float(i)) for i in range(50)] + [("c", 7.0)] + [("d", None)] * 3 + [("a", None)] + [("h", 1.0)] * 400 + [("h", 2.0), ("h", -1e300)]
    quantiles = [0.0, 0.5, 0.95, 1.0]
    got = audit.rank_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], quantiles, most).collect()
    assert {r["g"]: (r["n"], r["p0"], r["p50"], r["p95"], r["p100"], r["most"]) for r in got} == by_sorting(rows, quantiles)
    none = spark.createDataFrame([], "g string, v double")
    assert audit.rank_quantiles(none, "v", ["g"], [0.5]).count() == 0


def test_a_group_of_a_million_values_is_not_sorted_whole(spark, monkeypatch):
    rows = spark.range(1_000_000).select(F.lit("g").alias("g"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).alias("v"), F.lit(0).alias("clash"))
    seen = []
    real = audit.Window.partitionBy
    monkeypatch.setattr(audit.Window, "partitionBy", lambda *a: seen.append(a) or real(*a))
    got = audit.rank_quantiles(rows, "v", ["g"], [0.5, 0.95], most=5000).first()
    want = sorted(i * 7919 % 1_000_003 for i in range(1_000_000))
    assert (got["n"], got["p50"], got["p95"], got["most"]) == (1_000_000, want[500_000], want[950_000], want[-1]) and seen == [("g", "k")]


def plain(data):
    h = 0
    for b in data:
        h = (h * 31 + b) % (1 << 32)
    return h


def test_powers(spark):
    ns = [0, 1, 2, 31, 1000, 65536, 10**9, 2**35 + 12345]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", power(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in got} == {n: pow(31, n, 1 << 32) for n in ns}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_digests_however_cut(spark, size):
    rnd = random.Random(size)
    items = [(1, b""), (2, b"\xff" * 500), (3, bytes(range(256)) * 2), (4, rnd.randbytes(1000)), (5, None), (6, b"a")]
    frame = spark.createDataFrame(items, "id long, content binary")
    pieces = chunks(frame, "id", "content", size).orderBy(F.rand(3))
    assert {r.id: (r.digest, r.length) for r in digest_of_chunks(pieces, ["id"]).collect()} == {i: (plain(d), len(d)) for i, d in items if d is not None}
    assert {r.id: r.d for r in frame.select("id", digest(F.col("content")).alias("d")).collect()} == {i: None if d is None else plain(d) for i, d in items}


def test_needles_overlap_and_keep_their_priority(spark):
    from traceloom.functions.needles import Needles

    needles = Needles([("abc", "one"), ("bcd", "two"), ("b", "three"), ("cd", "one"), ("é.", "four"), ("b", "five")])
    texts = ["xABCDx", "ab", "", None, "É.", "zzz", "abc" * 1000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = frame.select("id", needles.hits(F.col("text")).alias("hits"), needles.first_name(F.col("text")).alias("name"), needles.first_of(needles.hits(F.col("text"))).alias("same")).collect()
    assert {r.id: r.hits for r in rows} == {0: ["abc", "b", "bcd", "cd"], 1: ["b"], 2: [], 3: None, 4: ["é."], 5: [], 6: ["abc", "b"]}
    assert {r.id: r.name for r in rows} == {r.id: r.same for r in rows} == {0: "one", 1: "three", 2: None, 3: None, 4: "four", 5: None, 6: "one"}
