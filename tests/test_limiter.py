"""The sliding log against brute force, as a table and as a stream."""

import random

from pyspark.sql import functions as F

from traceloom.operators.limiter import sliding_log
from traceloom.streaming.limiter import admitted_stream

RULES = [(10, 3), (60, 8)]


def brute(rows):
    kept, out = {}, {}
    for at, i, who in sorted(rows):
        log = kept.setdefault(who or "unknown", [])
        waits = []
        for seconds, most in RULES:
            inside = [t for t in log if at - t < seconds]
            if len(inside) >= most:
                waits.append(max(1, seconds - (at - inside[0])))
        out[i] = (not waits, max(waits, default=0))
        if not waits:
            log.append(at)
    return out


def made(spark):
    rng = random.Random(1)
    rows = [(1_000_000 + rng.randrange(300), i, rng.choice(["a", "b", "", None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "at long, id long, who string").withColumn("ts", F.timestamp_seconds("at"))
    return rows, frame.select("ts", "id", "who")


def test_table(spark):
    rows, frame = made(spark)
    got = {r.id: (r.admitted, r.retry) for r in sliding_log(frame, RULES, "who", "ts", "id").collect()}
    assert got == brute(rows) and sum(a for a, _ in got.values()) not in (0, len(rows))


def test_stream(spark, tmp_path):
    rows, frame = made(spark)
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    query = admitted_stream(stream, RULES, "who", "ts", "id").writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    assert {r.id: (r.admitted, r.retry) for r in spark.table("admitted").collect()} == brute(rows)


def test_the_state_of_a_key_ends(spark, tmp_path):
    """Keys whose calls can't count any more leave the state once the watermark has passed them."""
    early = spark.createDataFrame([(1_000_000 + i, i, f"k{i % 5}") for i in range(20)], "at long, id long, who string")
    late = spark.createDataFrame([(1_100_000 + i, 100 + i, "new") for i in range(3)], "at long, id long, who string")
    later = spark.createDataFrame([(1_200_000, 200, "new")], "at long, id long, who string")
    for k, frame in enumerate((early, late, later)):
        frame.withColumn("ts", F.timestamp_seconds("at")).select("ts", "id", "who").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = admitted_stream(stream, RULES, "who", "ts", "id").writeStream.format("memory").queryName("ending").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert spark.table("ending").count() == 24 and max(kept) >= 5 and kept[-1] == 1
