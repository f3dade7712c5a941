"""Fingerprints of versions on either side of a length, as the registered query makes them."""

import re

from pyspark.sql import functions as F

from traceloom.llm.queries import op4_fingerprints
from traceloom.llm.sketches import with_next


def parts(text):
    return {p for p in re.split(r"[.!?|\n]\s*", text) if p}


def test_versions_of_990_and_1010_characters_are_alike(spark, tmp_path):
    sentences = [f"sentence {i} has some words" for i in range(60)]
    long = ". ".join(sentences)
    rows = [(2, long[:990]), (1, long[:1010]), (0, long + "\n" + ". ".join(f"other {i}" for i in range(400)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op4_fingerprints(spark, str(tmp_path)).collect():
        k = next(k for k, (i, _) in enumerate(rows) if i == r.doc_id)
        text, after = rows[k][1], rows[(k + 1) % 3][1]
        half = len(text) // 2
        for near, other in ((r.near_edited, text[: len(text) - half] + after[:half]), (r.near_next, after)):
            assert abs(near - len(parts(text) & parts(other)) / len(parts(text) | parts(other))) < 1e-9
        assert r.near_edited > 0.2 and r.near_next > (0.9 if r.doc_id == 2 else 0)


def test_an_id_that_very_many_rows_have_is_dealt_out(spark):
    """A third of the rows with one id, a tenth with another, and some with none: each has the next in the order, and no bucket holds many."""
    rows = [(7 if i % 3 == 0 else 12 if i % 10 == 1 else None if i % 10 == 2 else i, f"text number {i} " * (1 + i % 3)) for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    placed = with_next(frame).filter("tail = 0")
    got = {(r.doc_id, r.text): r.next for r in placed.select("doc_id", "text", "next").collect()}
    marks = {r.text: r.mark for r in frame.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("mark")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -marks[r[1]]))
    assert got == {order[k]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    assert placed.groupBy("bucket").count().agg(F.max("count")).first()[0] < 300
