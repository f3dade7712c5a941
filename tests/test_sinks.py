"""Written files, table functions, totals over sets of keys, typed values."""

import os
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceloom.functions import values
from traceloom.functions.tables import register_table_functions
from traceloom.operators import rollups
from traceloom.operators.guides import scalar
from traceloom.sources.binaries import FolderWriter, cleaned_name, numbered_name, write_files
from traceloom.sources.files import read_files


def test_names_that_clash():
    taken = {}
    names = ["a.jpg", "A.JPG", "a.jpg", "a-2.jpg", "a", "a", ".hidden", ".hidden", "../../etc/x", "c:\\d\\x", "..", "", "a.tar.gz"]
    got = [numbered_name(n, taken) for n in names]
    assert got == ["a.jpg", "A-2.JPG", "a-3.jpg", "a-2-2.jpg", "a", "a-2", ".hidden", ".hidden-2", "x", "x-2", "file", "file-2", "a.tar.gz"] and len(taken) == len(names)
    assert len({g.lower() for g in got}) == len(got)


def test_names_of_cleaned_files(spark):
    rows = [("photo.JPEG", "jpeg"), ("a/b/notes", "markdown"), ("x.png", "webp"), ("odd.xyz", "unknown"), (None, "png"), ("plain", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "name string, format string").select(cleaned_name(F.col("name"), F.col("format"))).collect()]
    assert got == ["photo-clean.jpg", "notes-clean.md", "x-clean.webp", "odd-clean.xyz", "image-clean.png", "plain-clean"]


def test_written_files_read_back(spark, tmp_path):
    rows = [(f"f{i % 7}.bin", bytes([i]) * i, "clash") for i in range(1, 40)] + [(None, b"x", ""), ("null.bin", None, ""), ("empty.bin", b"", "")]
    frame = spark.createDataFrame(rows, "name string, content binary, path string").repartition(5)
    write_files(frame, str(tmp_path / "out"))
    found = [bytes(r.content) for r in read_files(spark, str(tmp_path / "out")).collect()]
    assert sorted(found) == sorted(bytes([i]) * i for i in range(1, 40))
    names = [os.path.join(d, n) for d, _, files in os.walk(tmp_path / "out") for n in files]
    assert len(names) == 40 and any(n.endswith("/empty.bin") for n in names) and not os.path.exists(tmp_path / "out/_staged")
    write_files(frame.limit(0), str(tmp_path / "out"))
    write_files(frame.filter("name = 'f1.bin'"), str(tmp_path / "out"), mode="overwrite")
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "out")) == len([r for r in rows if r[0] == "f1.bin"])


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    @F.udf("binary")
    def fails(i):
        if i == 63:
            raise RuntimeError("on purpose")
        return b"x"

    frame = spark.range(64, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), fails("id").alias("content"))
    with pytest.raises(Exception, match="on purpose"):
        write_files(frame, str(tmp_path / "out"))
    assert not [n for _, _, files in os.walk(tmp_path) for n in files]
    with pytest.raises(Exception, match="name"):
        frame.drop("content").write.format("folder_of_files").mode("append").save(str(tmp_path / "out"))


def test_tasks_at_work_when_their_job_is_aborted(tmp_path):
    """They fail and leave nothing, whether they had begun to write or not."""
    names = lambda: [n for _, _, files in os.walk(tmp_path) for n in files]
    batch = lambda k: pa.RecordBatch.from_pydict({"name": [f"f{k}"], "content": [b"x"]})
    late = FolderWriter(str(tmp_path / "late"), False)
    late.abort([None])
    with pytest.raises(OSError):
        late.write(iter([batch(0)]))
    assert not names()
    for turn in range(20):
        writer = FolderWriter(str(tmp_path / f"busy{turn}"), False)
        with ThreadPoolExecutor(4) as pool:
            tasks = [pool.submit(writer.write, map(batch, range(100_000))) for _ in range(4)]
            while len(names()) < 40 and not any(t.done() for t in tasks):
                pass
            writer.abort([None] * 4)
            assert all(isinstance(t.exception(), OSError) for t in tasks)
        assert not names() and not os.path.exists(tmp_path / f"busy{turn}/_staged")


def test_table_functions_of_odd_contents(spark):
    assert set(register_table_functions(spark)) >= {"jpeg_segments", "png_chunks", "webp_chunks", "jumbf_boxes", "svg_tokens"}
    spark.createDataFrame([(1, None, None), (2, b"", ""), (3, b"text", "a<b>c</b><!-- x"), (4, b"\xff\xd8\xff\xfe\0\x04ab\xff\xd9", "<svg a='>'/>")], "id int, content binary, text string").createOrReplaceTempView("odd_files")
    for name in ("jpeg_segments", "png_chunks", "webp_chunks", "jumbf_boxes"):
        assert spark.sql(f"SELECT id FROM odd_files, LATERAL {name}(content)").count() == (2 if name == "jpeg_segments" else 0)
    tokens = spark.sql("SELECT id, array_agg(token) AS t FROM odd_files, LATERAL svg_tokens(text) GROUP BY id").collect()
    assert {r.id: r.t for r in tokens} == {3: ["a", "<b>", "c", "</b>", "<!-- x"], 4: ["<svg a='>'/>"]}


def test_levels_tell_summed_keys_from_null_ones(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "k string, l string, n int")
    got = {(r.k, r.l, r.level): r.n for r in rollups.rolled_up(rows, ["k", "l"], F.sum("n").alias("n")).collect()}
    assert got == {("a", None, 0): 1, ("a", "x", 0): 2, (None, "x", 0): 4, ("a", None, 1): 3, (None, None, 1): 4, (None, None, 3): 7}
    assert rollups.cubed(rows, ["k", "l"], F.sum("n").alias("n")).filter("level = 2").count() == 2
    assert rollups.rolled_up(rows.limit(0), ["k"], F.count("*").alias("n")).count() == 0


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") % 25_000).alias("user"), (F.col("id") % 2).alias("half"))
    days = rollups.distinct_sketches(rows, ["day", "half"], "user")
    total = rollups.merged_counts(days, []).first()["estimate"]
    assert abs(total - 25_000) <= 3 * 1.04 / 64 * 25_000
    halves = rollups.merged_counts(days, ["half"]).collect()
    assert len(halves) == 2 and all(abs(r.estimate - 12_500) <= 3 * 1.04 / 64 * 12_500 for r in halves)
    assert rollups.distinct_sketches(rows.select("day", F.lit(None).cast("long").alias("user")), ["day"], "user").select(F.hll_sketch_estimate("sketch")).distinct().first()[0] == 0


def test_typed_values_and_their_print(spark):
    raw = ["12", "007", "-0.50", "true", "null", "~", "'it''s'", '"a \\"b\\""', "plain: text", "", "é\\n"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", values.typed_value(scalar(F.col("raw"))).alias("v"))
    got = [r.j for r in rows.orderBy("i").select(F.to_json("v").alias("j")).collect()]
    assert got == ["12", "7", "-0.5", "true", "null", "null", '"it\'s"', '"a \\"b\\""', '"plain: text"', '""', '"é\\\\n"']
    texts = ['{"a":[1,{"b":"é"}],"c":{}}', "[]", "no json", None]
    shown = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(values.pretty_json("t")).collect()]
    assert shown == ['{\n  "a": [\n    1,\n    {\n      "b": "é"\n    }\n  ],\n  "c": {}\n}', "[]", None, None]
