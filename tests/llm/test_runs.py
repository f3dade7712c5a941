"""Shared runs of words against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from traceloom.llm import runs
from traceloom.llm.queries import op7_passages
from traceloom.llm.runs import shared_runs
from traceloom.llm.shared import ascii_lower


def runs_of(rows):
    """(id, first word, words) of all maximal stretches of windows of 50 words that another id has."""
    words = [(t or "").lower().split() for _, t in rows]
    holders = {}
    for (i, _), ws in zip(rows, words):
        for k in range(len(ws) - 49):
            holders.setdefault(tuple(ws[k : k + 50]), set()).add(i)
    want = set()
    for (i, t), ws in zip(rows, words):
        start = None
        for k in range(len(ws) - 48):
            hit = k <= len(ws) - 50 and len(holders[tuple(ws[k : k + 50])] - {None}) > 1
            if hit and start is None:
                start = k
            if not hit and start is not None:
                want.add((i, start, k - start + 49))
                start = None
    return want


def test_runs_that_go_over_from_one_partner_to_the_next(spark):
    """Long texts whose parts others have, in pieces that overlap by more or less than a window, with words put in or left out."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for family in range(12):
        base = [word() for _ in range(400)]
        rows.append((100 * family, " ".join(base)))
        at = 0
        for k in range(1, 7):
            part = base[max(at - rng.choice([0, 10, 25, 49, 50, 60]), 0) : at + rng.randrange(40, 130)]
            at += 60
            if k % 2:
                cut = rng.randrange(len(part))
                part = part[:cut] + [word()] * (k % 3) + part[cut + rng.randrange(2) :]
            rows.append((100 * family + k, " ".join([word() for _ in range(rng.randrange(30))] + part + [word() for _ in range(rng.randrange(30))])))
    got = {(r.doc_id, r.first_word, r.n_words) for r in shared_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == runs_of(rows)


def test_wrapped_and_embedded_passages(spark, none, odd, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [[word() for _ in range(n)] for n in (49, 50, 60, 120)], []
    for i in range(40):
        words = [word() for _ in range(rng.randrange(20))] + rng.choice(base) + [word() for _ in range(rng.randrange(90))]
        text = words[0]
        for w in words[1:]:
            text += (rng.choice([" ", " ", " ", "\n", "  "]) if i % 3 else " ") + (w.upper() if i % 5 == 0 else w)
        rows.append((i, text))
    rows += [(None, rows[0][1]), (40, "é " * 60), (41, None)]
    want = runs_of(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op7_passages(spark, str(tmp_path)).filter("first_word is not null").collect()
    assert {(r.doc_id, r.first_word, r.n_words) for r in out} == want and len(want) > 20
    classes = {r.class_id for r in out}
    assert len(classes) == 3 and sum(r.kept for r in out) == 3
    assert all(sum(x.class_id == r.class_id for x in out) == r.occurrences for r in out)
    assert shared_runs(none).count() == 0 and shared_runs(odd).count() >= 0


def test_equal_texts_are_looked_at_once(spark, monkeypatch):
    """Copies add rows to the result, not windows to the work; an id with a text twice counts once, and null ids don't make a run shared."""
    seen, join = [], runs.join_groups

    def joined(rows, *more):
        if {"seq", "h"} <= set(rows.columns):
            seen.append(rows.count())
        return join(rows, *more)

    monkeypatch.setattr(runs, "join_groups", joined)
    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    copied, part, lone, null = text("a", 80), text("a", 60) + " " + text("b", 30), text("c", 90), text("d", 70)
    rows = [(i, copied) for i in range(30)] + [(None, copied), (3, copied), (30, part), (31, lone), (31, lone), (None, null), (None, null), (32, null)]
    out = shared_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_word, r.n_words) for r in out} == runs_of(rows) and len(out) == 32
    assert {r.occurrences for r in out} == {32} and [r.doc_id for r in out if r.kept] == [0]
    assert seen and max(seen) <= 31 + 41


def test_texts_hashed_together_are_as_each_alone(monkeypatch):
    """Texts beside each other, empty, short, long and repeating ones: words, and the windows chosen, are those of each text."""
    rng = random.Random(4)
    texts = ["", " ", "a " * 120, "ab CD " * 90, "x\ny\n\nZ " * 40, "É ü " * 70, "", "\n" * 9 + "w " * 49, "no-blank", "at the end", ""]
    texts += [" ".join(rng.choice(["p", "Q", "r"]) for _ in range(400)), " ".join(str(rng.random()) for _ in range(900)), " ".join(f"w{k % 30}" for k in range(300)), "one\x00two"]
    value = lambda word: sum((c + 1) * pow(runs._BASE, k, 1 << 64) for k, c in enumerate(word.lower())) % (1 << 64)
    for order, size in ((texts, 1 << 18), (texts[::-1], 1 << 18), (texts, 300), (texts, 1)):
        monkeypatch.setattr(runs, "SLICE", size)
        seen = 0
        for a, b, data, bounds in runs.slices(pa.array([None, *order]).slice(1)):
            assert a == seen and b > a
            seen = b
            words, begins = runs.word_hashes(data, bounds)
            bounds = np.searchsorted(begins, bounds)
            places, of, hashes = runs.chosen_of(words, bounds)
            for k, text in enumerate(order[a:b]):
                own = words[bounds[k] : bounds[k + 1]]
                assert own.tolist() == runs._mixed(np.array([value(w) for w in text.encode().split()], np.uint64)).tolist()
                want = runs.chosen(own)
                assert (places[of == k] - bounds[k]).tolist() == want.tolist()
                assert not len(want) or (hashes[of == k] == runs.windows(own, runs.WINDOW)[want]).all()
        assert seen == len(order)


def test_letters_other_than_a_to_z_keep_their_case(spark):
    texts = ["ABC xyz [@`{", "ABÄÖ İıſK Ωz", "", None, "Z\x00\x7f\tA"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", ascii_lower(F.col("t")).alias("low")).collect()
    assert {r.k: r.low for r in got} == {k: t and "".join(c.lower() if c < "\x80" else c for c in t) for k, t in enumerate(texts)}
