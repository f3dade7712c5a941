"""The genetic part of packing against plain best fit and lower bounds; resampling and quotients against brute force."""

import random

import numpy as np
import pytest

from traceloom.llm import audio
from traceloom.llm.language import classify, gram_counts
from traceloom.llm.mixing import sainte_lague
from traceloom.llm.packing import best_fit_into, evolve, least_bins


def plain(sizes, capacity):
    return len(best_fit_into(sizes, range(len(sizes)), [], [], capacity)[0])


def test_generations_beat_best_fit_on_a_hard_instance():
    rng = random.Random(1)
    sizes = [rng.randint(300, 1000) for _ in range(1024)]
    packed = evolve(sizes, [], 2048, 24, 8, 2)[0]
    assert sorted(i for b in packed for i in b) == list(range(1024)) and all(sum(sizes[i] for i in b) <= 2048 for b in packed)
    assert len(packed) <= least_bins(sizes, 2048) + 2 and plain(sizes, 2048) >= len(packed) + 8


def fewest(sizes, capacity):
    """The fewest bins, by trying every place of every size."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity:
                place(k + 1, bins[:b] + [bins[b] + sizes[k]] + bins[b + 1 :])
        place(k + 1, bins + [sizes[k]])

    place(0, [])
    return best


def test_small_instances_are_near_the_fewest_bins():
    rng, more = random.Random(2), 0
    for _ in range(40):
        sizes = [rng.randint(1, 60) for _ in range(8)]
        want = fewest(sorted(sizes, reverse=True), 100)
        assert least_bins(sizes, 100) <= want
        got = len(evolve(sizes, [], 100, 20, 6, 2)[0])
        more += got - want
        assert want <= got <= plain(sizes, 100)
    assert more <= 2


def test_runs_of_audio_have_no_seams(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 576 * 10, dtype=np.uint8).tobytes()
    for rate, target in ((8000, 16000), (8000, 11025), (8000, 6000)):
        for codec in audio.FORMATS:
            samples = audio.decode(np.frombuffer(data, np.uint8), codec).tolist()
            at = [divmod(k * rate, target) for k in range(-(-len(samples) * target // rate))]
            want = [(samples[p] * (target - q) + samples[min(p + 1, len(samples) - 1)] * q) // target for p, q in at]
            whole = np.concatenate(list(audio.pcm_runs(data, codec, rate, target)))
            assert whole.tolist() == want
            signs = [x < 0 for x in want]
            line = f"n={len(want)},peak={max(map(abs, want))},zc={sum(a != b for a, b in zip(signs, signs[1:]))},ms={sum(x * x for x in want) // len(want)}"
            with monkeypatch.context() as m:
                m.setattr(audio, "RUN", 36 * 7)
                assert audio.measured(audio.pcm_runs(data, codec, rate, target)) == line


def test_grams_across_chunks_and_out_of_place_distance(monkeypatch):
    import traceloom.llm.language as m

    rng = random.Random(3)
    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(m, "CHUNK", size)
        for _ in range(30):
            text = "".join(rng.choice("abÄß ,1\n") for _ in range(rng.randrange(30)))
            letters = "".join(c if c.isalpha() else " " for c in text.lower())
            line = " " + " ".join(letters.split()) + " " if letters.split() else " "
            want = {}
            for n in (1, 2, 3):
                for k in range(len(line) - n + 1):
                    gram = line[k : k + n]
                    if gram.strip():
                        code = sum(ord(c) << 21 * (n - 1 - j) for j, c in enumerate(gram))
                        want[code & (1 << 63) - 1] = want.get(code & (1 << 63) - 1, 0) + 1
            codes, counts = gram_counts(text)
            assert dict(zip((codes & (1 << 63) - 1).tolist(), counts.tolist())) == want
    profiles = {"x": [ord("a"), ord("b"), ord("c")], "y": [ord("c"), ord("a")]}
    lang, score = classify("aab", m._table(profiles), 400)
    grams = sorted(zip(*map(np.ndarray.tolist, gram_counts("aab"))), key=lambda g: (-g[1], g[0]))
    grams = [g for g, _ in grams if g != 32 << 21 | 32]
    away = {k: sum(abs(p.index(g) - r) if g in p else 400 for r, g in enumerate(grams)) for k, p in profiles.items()}
    assert lang == min(sorted(away), key=away.get) and score == 1 - away[lang] / (400 * len(grams))


@pytest.mark.parametrize("votes,seats", [([4096] * 30 + [17], 60000), ([5, 3, 2], 7), ([100, 1, 1, 1], 50), ([7] * 9, 63), ([1] * 50, 20)])
def test_seats_by_highest_quotients(spark, votes, seats):
    rows = [(i, v, seats, v) for i, v in enumerate(votes)]
    got = {r.p: r._seats for r in sainte_lague(spark.createDataFrame(rows, "p long, v long, s long, m long"), [], "p", "v", "s", "m", limited=False).collect()}
    quotients = sorted(((-v / (2 * k - 1), i, k) for i, v in enumerate(votes) for k in range(1, v + 1)))[:seats]
    assert got == {i: sum(j == i for _, j, _ in quotients) for i in range(len(votes))}
