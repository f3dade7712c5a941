"""Admission control: fixed buckets by windows, and a sliding log as keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_buckets(calls: DataFrame, rules: list[tuple[int, int]], key: str, ts: str, order: str) -> DataFrame:
    """calls with admitted and denied_by (seconds of the rule). Rules (seconds, most) apply in turn.

    A call that a later rule denies has used up the earlier rules' buckets. Windows are partitioned by
    key and bucket, so they are as small as the bucket is short.
    """
    epoch = F.unix_seconds(F.col(ts).cast("timestamp"))
    out = calls.withColumn("denied_by", F.lit(None).cast("int")).withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown")))
    for seconds, most in rules:
        bucket = Window.partitionBy(key, F.floor(epoch / seconds), F.col("denied_by").isNull()).orderBy(ts, order)
        over = F.col("denied_by").isNull() & (F.row_number().over(bucket) > most)
        out = out.withColumn("denied_by", F.when(over, seconds).otherwise(F.col("denied_by")))
    return out.withColumn("admitted", F.col("denied_by").isNull())


def sliding_log(calls: DataFrame, rules: list[tuple[int, int]], key: str, ts: str, order: str) -> DataFrame:
    """key, order, admitted, retry: a call is admitted if each rule's last `seconds` hold fewer than `most` admitted calls.

    The calls of a key come in batches in time order; the state between them is its admitted calls
    within the longest rule, at most the sum of the rules' limits.
    """
    longest = max(s for s, _ in rules)

    def run(batches):
        now, log = None, []
        for pdf in batches:
            admitted, retry = [], []
            for who, at in zip(pdf["who"], pdf["at"]):
                if who != now:
                    now, log = who, []
                log = [t for t in log if at - t < longest * 1_000_000]
                waits = []
                for seconds, most in rules:
                    inside = [t for t in log if at - t < seconds * 1_000_000]
                    if len(inside) >= most:
                        waits.append(max(1, -(-(seconds * 1_000_000 - (at - inside[0])) // 1_000_000)))
                admitted.append(not waits)
                retry.append(max(waits, default=0))
                if not waits:
                    log.append(at)
            yield pd.DataFrame({"who": pdf["who"], "id": pdf["id"], "admitted": admitted, "retry": retry})

    named = calls.select(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown")).alias("who"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("id"))
    dealt = named.repartition("who").sortWithinPartitions("who", "at", "id")
    return dealt.mapInPandas(run, "who string, id long, admitted boolean, retry long").select(F.col("who").alias(key), F.col("id").alias(order), "admitted", "retry")
