"""Ranked search, resampling and the tokenizer's automaton against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from traceloom.llm import search as module
from traceloom.llm.resampling import resample
from traceloom.llm.search import Treaps, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=10):
    """(item, rank, doc_id, score) by scoring every document."""
    found = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    found = [(d, w, Counter(w)) for d, w in found if w]
    n, length = len(found), sum(len(w) for _, w, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    rows = []
    for item, text in items:
        scores = []
        for doc, words, counts in found:
            m = 25 + 75 * len(words) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in counts)
            if score > 0:
                scores.append((-score, doc is None, doc))
        rows += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return rows


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ÉTÉ", "x_y", "THE", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 30, 200]))) for _ in range(n)]


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("segment,block", [(1 << 20, 1 << 18), (900, 40), (300, 1 << 18)])
def test_search_equals_scoring_everything(spark, monkeypatch, segment, block):
    monkeypatch.setattr(module, "BLOCK_TERMS", block)
    docs = list(enumerate(texts(3, 400))) + [(1000 + i, "w1 w2 w3 the") for i in range(40)] + [(None, "w5 w50 ünder"), (7, "w5 w50 ünder"), (500, None)]
    random.Random(1).shuffle(docs)
    items = [(i, t) for i, t in enumerate(texts(5, 25))] + [(90, "The w1 w1 w1"), (91, None), (92, "nowhere"), (93, "w5 w50 ünder")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string").repartition(3)
    monkeypatch.setattr(module, "SEGMENT", segment)
    got = rows(search(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert got == sorted(ranked(docs, items))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("small", [0, 3, 50])
def test_treaps_walked_range_by_range(monkeypatch, seed, small):
    monkeypatch.setattr(module, "SMALL", small)
    rnd = np.random.default_rng(seed)
    n, vocabulary = 300, 12
    held = rnd.random((vocabulary, n)) < rnd.random((vocabulary, 1))
    impact = rnd.integers(1, 4 if seed % 2 else 10**9, (vocabulary, n)) * held
    term, doc = np.nonzero(held)
    order = rnd.permutation(len(term))
    treaps = Treaps(term[order], doc[order], impact[term[order], doc[order]])
    for t, (root, start, stop) in treaps.slice.items():
        assert treaps.impact[root] == treaps.impact[start:stop].max() and (np.diff(treaps.doc[start:stop]) > 0).all()
    ids = [(False, i) for i in range(n)]
    for query in ([(0, 1)], [(0, 2), (3, 1), (7, 1)], [(t, 1 + t % 3) for t in range(vocabulary)], [(99, 1)]):
        best = []
        treaps.search(query, best, 10, ids)
        scores = sum((impact[t] * times for t, times in query if t < vocabulary), np.zeros(n, int))
        assert best == sorted((-int(s), False, i) for i, s in enumerate(scores) if s)[:10]


def test_search_prunes(monkeypatch):
    """Of many documents that a query's terms are in, few are looked at where a few stand out."""
    monkeypatch.setattr(module, "SMALL", 64)
    n = 20000
    impact = np.ones((3, n), np.int64)
    impact[:, 5000:5010] = 1000
    seen = []
    treaps = Treaps(np.repeat(np.arange(3), n), np.tile(np.arange(n), 3), impact.ravel())
    real = Treaps.sums
    monkeypatch.setattr(Treaps, "sums", lambda self, start, stop, times: seen.append(int((stop - start).sum())) or real(self, start, stop, times))
    best = []
    treaps.search([(0, 1), (1, 1), (2, 1)], best, 10, [(False, i) for i in range(n)])
    assert [d for _, _, d in best] == list(range(5000, 5010)) and sum(seen) < n // 10


def test_search_of_odd_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "one wörds"), (1, "one wörds"), (None, "x y z"), (2, "")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = ranked(docs, [(1, "one wörds"), (1, "one wörds"), (None, "x y z")])
    assert rows(search(odd, items)) == sorted(want, key=lambda r: (r[0] is None, r))
    assert rows(search(none, items)) == [] and rows(search(odd, items.limit(0))) == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def drawn(docs, target, longest, buckets, least, percent, seed):
    def buckets_of(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    each = [(d, *buckets_of(t)) for d, t in docs]
    s, t = Counter(b for _, _, bs in each for b in bs), Counter(b for x in target for b in buckets_of(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for doc, n, bs in each:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        out.append((doc, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((i for i, r in enumerate(out) if r[4]), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    rank = {i: r for r, i in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*r[:4], rank.get(i)) for i, r in enumerate(out)), key=repr)


@pytest.mark.parametrize("longest,buckets,least,percent", [(1, 10000, 20, 10), (2, 97, 5, 50), (3, 7, 0, 100)])
def test_resampling_equals_the_plain_computation(spark, longest, buckets, least, percent):
    docs = list(enumerate(texts(11, 300))) + [(None, "w1 " * 30), (900, None), (901, ""), (902, "a b c " * 20)]
    target = texts(12, 20) + [None]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, rank string").repartition(4)
    got = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets, least, percent)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == drawn(docs, target, longest, buckets, least, percent, 2024)


def test_resampling_of_repeated_rows_and_empty_tables(spark, odd, none):
    target = spark.createDataFrame([("one two",)], "text string")
    got = resample(odd, target, least_words=1, percent=50).collect()
    eligible = [r for r in odd.collect() if WORD.findall(r.text or "")]
    assert len(got) == odd.count() and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(eligible) // 2 + 1))
    assert resample(none, target).count() == 0 and resample(odd, none).count() == odd.count()
