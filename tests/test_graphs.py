"""Object graphs, revisions, boxes and ranges at their edges."""

import pytest
from pyspark.sql import functions as F

from traceloom.functions.hidden import NAMES, findings, named_ranges
from traceloom.functions.intervals import join_ranges
from traceloom.operators.boxes import box_trees, find_boxes, walk_boxes
from traceloom.operators.objects import mark, rebuild
from traceloom.operators.revisions import revision_chains, revision_entries, visible_entries

GRAPH = "item string, node int", "item string, src int, dst int, position int"


def test_items_are_marked_together_and_refused_apart(spark):
    chain = [("a", i) for i in range(6)]
    objects = [*chain, *chain, ("b", 10), ("b", 30), ("b", 20), ("b", 99), ("c", 1), (None, 1), ("d", None)]
    refs = [("a", i, i + 1, 0) for i in range(5)] + [("b", 10, 30, 0), ("b", 10, 77, 1), ("b", 30, 10, 0), ("b", 30, 20, 5), ("b", 30, 20, 2), ("b", 99, 10, 0), (None, 1, 1, 0), ("e", 1, 2, 0)]
    roots = [("a", 0), ("b", 10), ("c", 5), (None, 1), ("z", 1), ("b", 10)]
    frames = spark.createDataFrame(objects, GRAPH[0]), spark.createDataFrame(refs, GRAPH[1]), spark.createDataFrame(roots, GRAPH[0])
    got = {(r["item"], r["node"]): (r["new_number"], r["depth"], r["targets"], r["reason"]) for r in rebuild(*frames, most=5).collect()}
    assert got == {
        ("b", 10): (1, 0, [3, None], None), ("b", 20): (2, 2, [], None), ("b", 30): (3, 1, [1, 2, 2], None),
        ("a", None): (None, None, None, "too many objects"), ("c", None): (None, None, None, "no root"), ("z", None): (None, None, None, "no root"),
    }
    assert rebuild(*frames, most=6).filter("item = 'a'").count() == 6


def test_a_loop_and_a_wide_root_end(spark):
    objects = spark.range(2000).select(F.lit("w").alias("item"), F.col("id").cast("int").alias("node"))
    refs = objects.select("item", F.lit(0).alias("src"), F.col("node").alias("dst")).union(objects.select("item", F.col("node").alias("src"), F.lit(0).alias("dst")))
    reached, refused = mark(objects, refs, spark.createDataFrame([("w", 0)], GRAPH[0]))
    assert reached.count() == 2000 and reached.agg(F.max("depth")).first()[0] == 1 and refused.count() == 0
    none = objects.limit(0)
    reached, refused = mark(none, refs.limit(0), none)
    assert reached.count() == refused.count() == 0


def xref(rows, end=b" \n", start=0):
    return b"xref\n%d %d\n" % (start, len(rows)) + b"".join(b"%010d %05d %s%s" % (offset, 0, use, end) for offset, use in rows)


def tail(at, before=None):
    return b"trailer\n<< /Size 9" + (b"" if before is None else b" /Prev %d" % before) + b" >>\nstartxref\n%d\n%%%%EOF\n" % at


def test_chains_of_odd_files(spark):
    plain = xref([(0, b"f"), (15, b"n"), (16, b"n")]) + tail(0)
    crlf = b"\xff\xfe" + xref([(5, b"n"), (6, b"n")], b"\r\n", 3).replace(b"xref\n", b"xref\r\n").replace(b"3 2\n", b"3 2\r\n") + tail(2)
    short = xref([(1, b"n")]).replace(b"0 1\n", b"0 7\n") + tail(0)
    blanks = b"ab  \n" + xref([(1, b"n")]) + tail(2)
    two = plain + (second := xref([(0, b"f"), (77, b"n")])) + tail(len(plain), 0)
    freed = plain + xref([(0, b"f"), (0, b"f")]) + tail(len(plain), 0)
    files = {"plain": plain, "crlf": crlf, "short": short, "blanks": blanks, "two": two, "freed": freed, "none": b"text", "empty": b"", "far": b"startxref\n99999999999", "null": None, "broken": plain[:-30], "twice": plain}
    rows = [*files.items(), ("twice", plain), (None, two)]
    chains, state = revision_chains(spark.createDataFrame([(k, v) for k, v in rows], "name string, content binary"), "name", "content")
    got = {}
    for r in state.collect():
        got.setdefault(r["id"], []).append((r["revisions"], r["state"]))
    assert got == {
        "plain": [(1, "whole")], "crlf": [(1, "whole")], "short": [(0, "degraded")], "blanks": [(1, "whole")], "two": [(2, "whole")], "freed": [(2, "whole")], "none": [(0, "no table")],
        "empty": [(0, "no table")], "far": [(0, "no table")], "null": [(0, "no table")], "broken": [(0, "no table")], "twice": [(1, "whole")] * 2, None: [(2, "whole")],
    }
    entries = revision_entries(chains)
    seen = {}
    for r in visible_entries(entries).collect():
        seen.setdefault(r["id"], []).append((r["object"], r["offset"], r["revision"]))
    seen = {k: sorted(v) for k, v in seen.items()}
    assert seen["plain"] == [(1, 15, 0), (2, 16, 0)] and seen["crlf"] == [(3, 5, 0), (4, 6, 0)] and seen["blanks"] == [(0, 1, 0)]
    assert seen["two"] == seen[None] == [(1, 77, 0), (2, 16, 1)] and seen["freed"] == [(1, 15, 1), (2, 16, 1)] and len(seen["twice"]) == 4
    assert sorted((r["object"], r["offset"]) for r in visible_entries(entries, 1).filter("id = 'two'").collect()) == [(1, 15), (2, 16)]
    assert second in two


def test_a_table_of_many_entries(spark):
    rows = [(i, b"n") for i in range(50_000)]
    chains, state = revision_chains(spark.createDataFrame([(1, xref(rows) + tail(0))], "name long, content binary"), "name", "content")
    entries = revision_entries(chains)
    assert entries.count() == 50_000 and entries.filter("object <> offset").count() == 0 and state.first()["state"] == "whole"


def box(kind, data, size=None):
    return (len(data) + 8 if size is None else size).to_bytes(4, "big") + kind + data


def test_boxes():
    told = box(b"jumd", b"x" * 8)
    data = b"talk of jumb and jumd" + box(b"jumb", told + box(b"jumb", told + box(b"a   ", b"")) + box(b"last", b"to the end", 0)) + b"rest" + box(b"jumb", told)
    (first, stop), (second, end) = find_boxes(data)
    assert (first, end) == (21, len(data)) and stop + 4 == second
    assert [(p, d, k, r) for p, d, k, _, _, r in walk_boxes(data, first, stop)] == [
        ("0", 0, "jumb", None), ("0/0", 1, "jumd", None), ("0/1", 1, "jumb", None), ("0/1/0", 2, "jumd", None), ("0/1/1", 2, "a   ", None), ("0/2", 1, "last", None),
    ]
    assert find_boxes(b"\0\0\0\x10jumb") == [] and find_boxes(box(b"jumb", box(b"cbor", b"12345678"))) == [] and find_boxes(b"\xff" * 4 + b"jumb" + told) == []
    long = (1).to_bytes(4, "big") + b"jumd" + (24).to_bytes(8, "big") + b"12345678"
    assert walk_boxes(box(b"jumb", long), 0, 32)[1] == ("0/0", 1, "jumd", 8, 32, None)
    deep = told
    for _ in range(3000):
        deep = box(b"jumb", told + deep)
    assert max(d for _, d, *_ in walk_boxes(deep, 0, len(deep))) == 3000


def test_boxes_of_repeated_null_and_empty_files(spark):
    data = box(b"jumb", box(b"jumd", b"x" * 8))
    rows = spark.createDataFrame([(1, data), (1, data), (None, data), (2, None), (3, b""), (4, data)], "item_id long, content binary")
    got = [(r["item_id"], r["path"]) for r in box_trees(rows).collect()]
    assert sorted(got, key=repr) == sorted([(i, p) for i in (1, 1, None, 4) for p in ("0", "0/0")], key=repr)
    assert box_trees(rows.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 7, 256, 10**6])
def test_ranges_join_whatever_the_width(spark, width):
    ranges = [(0, 0, "a"), (5, 300, "b"), (300, 301, "c"), (-20, -10, "d"), (9, 8, "e"), (None, 3, "f")]
    points = spark.range(-30, 320).selectExpr("id AS v").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    table = spark.createDataFrame(ranges, "start long, stop long, name string")
    got = sorted((r.v, r.name) for r in join_ranges(points, table, "v", width=width).collect())
    assert got == sorted((v, n) for v in range(-30, 320) for a, b, n in ranges if a is not None and a <= v <= b)
    assert join_ranges(points, table, "v", width=width, how="left").count() == 350 + 1 + 1


def test_every_hidden_character_has_one_name(spark):
    rows = named_ranges(spark)
    assert rows.count() == len(set(r[0] for r in rows.select("start").collect())) and {n for n, _ in NAMES} == {r.name for r in rows.collect()}
    text = "a​­﻿ \U000e0041‮\x07ㅤ"
    got = findings(spark.createDataFrame([(1, text), (1, "‍"), (None, "⠀"), (2, None), (3, "")], "id long, text string"), "id", "text")
    assert sorted((r["id"] or 0, r["idx"], r["name"]) for r in got.collect()) == [
        (0, 0, "Braille pattern blank"), (1, 0, "Zero-width joiner"), (1, 1, "Zero-width space"), (1, 2, "Soft hyphen"), (1, 3, "Zero-width no-break space (BOM)"), (1, 4, "Unusual space character"),
        (1, 5, "Tag character"), (1, 6, "Bidirectional override"), (1, 7, "Control character"), (1, 8, "Hangul filler"),
    ]
