"""The sliding log as a stream: admitted calls of a key are state that ends by itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Seconds that a key's state outlives the longest window.
GRACE = 60


def admitted_stream(calls: DataFrame, rules: list[tuple[int, int]], key: str, ts: str, order: str, late: str = "10 seconds") -> DataFrame:
    """who, id, admitted, retry of a stream of calls: a call is admitted if each rule's last `seconds` hold fewer than `most` admitted calls.

    Calls of a key are taken in time order within a batch. The state of a key is its admitted times
    within the longest rule, and ends GRACE seconds of event time after the last could count.
    """
    longest = max(s for s, _ in rules) * 1_000_000

    def run(who, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        calls = pd.concat(batches).sort_values(["at", "id"], kind="stable")
        admitted, retry = [], []
        for at in calls["at"]:
            log = [t for t in log if at - t < longest]
            waits = []
            for seconds, most in rules:
                inside = [t for t in log if at - t < seconds * 1_000_000]
                if len(inside) >= most:
                    waits.append(max(1, -(-(seconds * 1_000_000 - (at - inside[0])) // 1_000_000)))
            admitted.append(not waits)
            retry.append(max(waits, default=0))
            if not waits:
                log.append(int(at))
        state.update((log,))
        if log:
            state.setTimeoutTimestamp(max(log[-1] + longest + GRACE * 1_000_000, 1000 * state.getCurrentWatermarkMs() + 1_000_000) // 1000)
        yield pd.DataFrame({"who": who[0], "id": calls["id"], "admitted": admitted, "retry": retry})

    named = calls.withWatermark(ts, late).select(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown")).alias("who"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("id"), ts)
    return named.groupBy("who").applyInPandasWithState(run, "who string, id long, admitted boolean, retry long", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)
