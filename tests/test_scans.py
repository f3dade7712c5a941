"""Whole texts as scans of images."""

from pyspark.sql import functions as F

from traceloom.operators.containers import clean_images, image_segments
from traceloom.plans.queries import made_jpegs


def test_whole_texts_pass_through_cleaning(spark, tmp_path):
    rows = [(i, f"text {i} " * 100) for i in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = made_jpegs(spark, str(tmp_path))
    cleaned = clean_images(image_segments(made, "doc_id", "content"))
    column = next(f.name for f in cleaned.schema if f.dataType.simpleString() == "binary" and f.name != "content")
    for r in cleaned.collect():
        assert rows[r[cleaned.columns[0]]][1].encode() in bytes(r[column])
