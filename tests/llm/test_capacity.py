"""Shards of a fixed size where few groups fit together."""

import random
from collections import Counter

import pytest

from traceloom.llm.sharding import assign_groups


@pytest.mark.parametrize("low,high,most", [(600, 600, 3000), (501, 1000, 3000), (1, 999, 1700), (260, 340, 1100)])
def test_fixed_capacity_ends_and_holds(spark, monkeypatch, low, high, most):
    import traceloom.llm.sharding as m

    monkeypatch.setattr(m, "CELL", 200)
    rng = random.Random(low)
    weights = [rng.randint(low, high) for _ in range(3000)]
    groups = spark.createDataFrame([(str(i).encode(), w) for i, w in enumerate(weights)], "group binary, weight long")
    rows = assign_groups(groups, capacity=1000).collect()
    assert sorted((int(bytes(r.group)), r.weight) for r in rows) == list(enumerate(weights))
    load = Counter()
    for r in rows:
        load[r.shard] += r.weight
    assert max(load.values()) <= 1000 and len(load) <= most
