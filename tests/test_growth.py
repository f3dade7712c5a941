"""What keeps the work and the memory of queries in step with their input."""

import pyarrow as pa
from pyspark.sql import functions as F

from traceloom.functions.slices import in_slices
from traceloom.functions.texts import SPACE, WORD, word_number
from traceloom.operators.documents import scan_files
from traceloom.operators.guides import claims
from traceloom.operators.lint import lint
from traceloom.plans.queries_graphs import object_graphs


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_lint_counts_words_once(spark):
    items = spark.createDataFrame([(1, "---\ntitle: x\n---\n a b")], "id long, text string")
    assert optimized(lint(items, "id", "text")).count(WORD) == 1


def test_words_are_what_lies_between_spaces(spark):
    texts = ["", " ", "a", " a b\tc　d﻿e ", "été 日本\U0001f600 \x00\x1f ~!", "x" * 5000]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(word_number(F.col("t")), F.regexp_count("t", F.lit(f"[^{SPACE[1:]}+"))).collect()
    assert [r[0] for r in found] == [r[1] for r in found] == [0, 0, 1, 5, 4, 1]


def test_scanned_signals_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, b"<svg><title>a</title></svg>") for i in range(3)], "item_id long, content binary")
    out = scan_files(rows)
    assert out.count() == 48
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_python_holds_a_slice_of_a_batch():
    import tracemalloc

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.binary())]))
    many = lambda data: None if data is None else [{"a": i, "b": data + bytes([i])} for i in range(20)]
    column = pa.array([b"x" * 100 if i % 7 else None for i in range(10_000)], pa.binary())
    tracemalloc.start()
    out = in_slices(many, (column,), kind)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 10_000 and out[0].as_py() is None and out[9_999].as_py() == many(b"x" * 100)
    assert peak < 8e6  # all rows at once take 60 MB
    assert len(in_slices(many, (column[:0],), kind)) == 0


def test_references_are_made_once(spark):
    out = object_graphs(spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet"))]


def test_claims_take_one_pass(spark):
    text = "It is undetectable.\n" * 2 + "plain words here " * 1500 + "\nproves human"
    asked = spark.createDataFrame([(text,)], "t string").select(claims(F.col("t")).alias("c"))
    assert r"\G.*?(?:\bundetectable\b)" in optimized(asked)  # a search that starts anew at each character is quadratic
    assert [(c["name"], c["line"]) for c in asked.first()["c"]] == [("'undetectable'", 1), ("'undetectable'", 2), ("'proves human'", 4)]
