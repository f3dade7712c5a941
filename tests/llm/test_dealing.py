"""Sharding, mixing and packing."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from traceloom.llm.mixing import mix
from traceloom.llm.packing import best_fit_into, crossover, evolve, pack_documents, public_vocabulary, token_bytes
from traceloom.llm.sharding import CapacityTree, assign_groups, best_fit, shard_documents


def test_capacity_tree_is_balanced_and_exact():
    rng, tree, plain = random.Random(3), CapacityTree(), set()
    for n in range(2000):
        if rng.random() < 0.6:
            key = (rng.randrange(500), n)
            tree.add(*key)
            plain.add(key)
        else:
            size = rng.randrange(500)
            want = min((k for k in plain if k[0] >= size), default=None)
            assert tree.take(size) == want
            plain.discard(want)
    assert tree.root[3] <= 1.45 * (len(plain) + 2).bit_length()


def test_best_fit_takes_the_tightest_bin():
    placed, left = best_fit([7, 5, 3, 2], [8, 5, 6])
    assert placed == [0, 1, 2, 2] and left == [1, 0, 1]


def test_sharding(odd, none):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count()
    where, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        where[r.text_crc32, r["size"]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(none).count() == 0


def test_sharding_is_nearly_equal_and_runs_in_cells(spark, monkeypatch):
    import traceloom.llm.sharding as m

    monkeypatch.setattr(m, "CELL", 200)
    monkeypatch.setattr(m, "HEAVY", 50)
    rng = random.Random(1)
    weights = [int(rng.paretovariate(1.1) * 50) for _ in range(3000)]
    groups = spark.createDataFrame([(str(i).encode(), w) for i, w in enumerate(weights)], "group binary, weight long")
    load = Counter()
    rows = assign_groups(groups, 8).collect()
    assert sorted(bytes(r.group) for r in rows) == sorted(str(i).encode() for i in range(3000))
    for r in rows:
        load[r.shard] += r.weight
    assert max(load.values()) - min(load.values()) < 0.02 * sum(weights) / 8 or max(weights) > sum(weights) / 8
    fixed = Counter()
    capacity = max(weights) + 5000
    for r in assign_groups(groups, capacity=capacity).collect():
        fixed[r.shard] += r.weight
    assert max(fixed.values()) <= capacity and len(fixed) <= sum(weights) // capacity + 2


def targets(sizes, share=1.5, cap=2.0):
    """Brute force: reshare what exceeds the caps until none does."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_reaches_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * int(rng.paretovariate(0.9)), rng.choice(["a", "b", "b", "b", "c", "Z", None, "d"])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs).collect()
    assert sorted(r.doc_id for r in out) == list(range(700))
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for r in out:
        assert r["size"] == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r["size"]
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
    want = targets(sizes)
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    assert sorted(map(tuple, mix(docs).collect())) == sorted(map(tuple, out))


def test_mixing_odd_rows(odd, none):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mix(none).count() == 0


def test_tokens_equal_the_tokenizer():
    plain = Tokenizer.from_file(public_vocabulary())
    rng = random.Random(5)
    alphabet = "ab cd  \n\t.,'’sé😀  12<|endoftext|>\r\x1c\x85的"
    ids = token_bytes(public_vocabulary())
    texts = ["", " ", "a ", " a", "<|endoftext|>", "a <|endoftext|> b", "we're it's", "\n", "x \ny"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in texts:
        want = b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids)
        assert ids(text) == want, repr(text)


def test_genetic_packing_keeps_every_piece_and_does_not_worsen():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    first = evolve(sizes, [], 100, 0, 4, 2)
    last = evolve(sizes, [list(map(list, b)) for b in first], 100, 12, 4, 2)
    for bins in last + [crossover(first[0], first[-1], sizes, 100, rng)]:
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(last[0]) <= len(first[0]) <= -(-sum(sizes) // 100) * 1.1
    assert best_fit_into([3, 3], [0, 1], [], [], 5)[1] == [3, 3]


def check_packing(rows, docs, capacity):
    plain = Tokenizer.from_file(public_vocabulary())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        stop, start, piece = (len(ids) - 1) % capacity + 1, 0, 0
        while start < len(ids):
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start:stop]))
            want[doc, piece, start, stop - start, crc] += 1
            start, stop, piece = stop, stop + capacity, piece + 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    return len(sequences)


def test_packing(odd, none, spark, monkeypatch):
    import traceloom.llm.packing as m

    check_packing(pack_documents(odd, capacity=64).collect(), [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert pack_documents(none).count() == 0
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(0, 90)) for i in range(900)]
    monkeypatch.setattr(m.pack_items, "__defaults__", (128,) + m.pack_items.__defaults__[1:])
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=128).collect()
    assert check_packing(out, rows, 128) <= 1.03 * sum(r.length for r in out) / 128 + 1
