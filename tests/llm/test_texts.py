"""Secrets, languages, fingerprints, licenses, passages, audio and SimHash against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

import pytest

from traceloom.llm import audio
from traceloom.llm.audio import decode_adpcm, decode_media, documents_as_audio
from traceloom.llm.components import components
from traceloom.llm.language import identify_languages
from traceloom.llm.licenses import TEMPLATES, scan_licenses
from traceloom.llm import passages
from traceloom.llm.passages import repeated_passages, similar_links, within_edits
from traceloom.llm.secrets import RULES, arrays, code_points, find_secrets, load, redact, scan
from traceloom.llm.simhash import SHARED, near_duplicates, postings
from traceloom.llm.sketches import digests, fingerprint_versions, peel, sketch, subtract

PATTERNS = [
    re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
    *(re.compile(r.pattern) for r in RULES[3:]),
]
PIECES = ["password", "PassWd", "secret", "token", "api_key", "apikey", ":", "=", "'", '"', " ", "abc", "abcdef012", "AKIA", "ABCDEFGH0123456789", "deadbeef", "0123456789abcdef", "é", "\n", "-", "_", ".", "😀", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "xoxb-", "Z" * 30]


def brute_secrets(text):
    return sorted((m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if len(m[2] if k == 0 else m[0]) >= RULES[k].least)


def test_secret_scan_equals_regular_expressions():
    rng, scanner = random.Random(1), load(RULES, arrays(RULES))
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14)))
        data = text.encode()
        assert code_points(data, scan(data, scanner)) == brute_secrets(text), text


def test_secrets_query_and_redaction(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(12))) for i in range(300)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in find_secrets(docs).collect():
        spans = brute_secrets(rows[r.doc_id][1] or "")
        named = [f"{RULES[k].kind}:{s}:{e}" for s, e, k in spans]
        assert r.spans == ",".join(named)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, _, k in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(x for x, (_, _, k) in zip(named, spans) if k < 3).encode()).hexdigest()
    assert find_secrets(redact(docs)).filter("n_access + n_hex > 0").count() == 0
    assert find_secrets(odd).count() == odd.count() and find_secrets(none).count() == 0


def test_languages_on_held_out_documents(spark, odd, none):
    words = {"xx": "ta ke no mi ra so".split(), "yy": "gro bli schu fant wer".split(), "zz": "oui eau ième ent ait".split()}
    rng, rows, truth = random.Random(3), [], {}
    for i in range(240):
        lang = truth[i] = rng.choice(sorted(words))
        rows.append((i, " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(30)), lang if i % 7 else None))
    docs = spark.createDataFrame(rows + [(240, "1 2 3 !", "xx"), (241, None, "xx")], "doc_id long, text string, lang string")
    for r in identify_languages(docs).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id >= 240 else truth[r.doc_id])
    assert identify_languages(odd).count() == odd.count() and identify_languages(none).count() == 0


def parts(text):
    return {p for p in re.split(r"[.!?|\n]\s*", text) if p}


def test_fingerprints_of_versions(spark, odd, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    rows = [(i * 3, ". ".join(" ".join(word() for _ in range(3)) for _ in range(rng.choice([0, 1, 5, 20, 60]))) + "\n" * (i % 3) + "\n".join(word() for _ in range(rng.choice([0, 400])))) for i in range(80)]
    out = {r.doc_id: r for r in fingerprint_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            one, two = parts(text), parts(other)
            assert abs(near - (len(one & two) / len(one | two) if one | two else 1)) < 1e-9
        assert (r.fingerprint == r.edited_fingerprint) == (parts(text) == parts(edited))
    assert fingerprint_versions(none).count() == 0
    rows = fingerprint_versions(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_next <= 1 for r in rows)


def test_peeling_finds_the_differing_digests(spark):
    df = spark.createDataFrame([("a. b. c. d", "a. b. x. y. z")], "one string, two string").select(digests_of("one"), digests_of("two"))
    got = df.select("one", "two", peel(subtract(sketch(df["one"]), sketch(df["two"]))).alias("d")).first()
    assert set(got.d) == set(got.one) ^ set(got.two)


def digests_of(name):
    from pyspark.sql import functions as F

    return digests(F.col(name)).alias(name)


def test_licenses(spark, odd, none):
    rng = random.Random(5)
    bits = ["MIT", "mit", "license", "License,", "apache", "GENERAL", "public", "general", "x", "ünd", "\n", "--"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(40))) for i in range(200)]
    rows += [(200, "before " + TEMPLATES[0][1] + " after"), (201, TEMPLATES[3][1].replace("source and", "source, new and")), (202, TEMPLATES[3][1][:60]), (203, None)]
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    for r in scan_licenses(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in rows[r.doc_id][1] or ""))
        hits = sorted((k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= r.score <= 1
        assert r.labels == {200: "mit-text", 201: "bsd-text"}.get(r.doc_id, r.base_labels)
    assert scan_licenses(odd).count() == odd.count() and scan_licenses(none).count() == 0


def grams(line):
    words = line.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def linked(items, near):
    root = {i: i for i in items}
    for a in items:
        for b in items:
            if a < b and root[a] != root[b] and near(a, b):
                both, least = {root[a], root[b]}, min(root[a], root[b])
                root = {k: least if v in both else v for k, v in root.items()}
    return root


def distance(a, b):
    """Words to insert, delete or change."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edits_are_counted_as_the_whole_table_counts_them():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [rng.randrange(4) for _ in range(rng.randrange(14))] if rng.random() < 0.3 else [x for x in a if rng.random() > 0.1] + [9] * rng.randrange(2)
        for most in range(6):
            assert within_edits(a, b, most) == (distance(a, b) <= most), (a, b, most)


@pytest.mark.parametrize("changes,least", [(1, 1.0), (2, 0.97), (3, 0.93), (5, 0.7)])
def test_recall_of_lines_with_changed_words(spark, changes, least):
    """Lines of 60 words in pairs, some words of one changed; the bands' own probabilities are stated beside BANDS."""
    rng = random.Random(changes)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(150):
        line = [word() for _ in range(60)]
        other = list(line)
        for at in rng.sample(range(60), changes):
            other[at] = word()
        rows += [(2 * i, " ".join(line)), (2 * i + 1, "\n".join([" ".join(word() for _ in range(50)), " ".join(other)]))]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = defaultdict(set)
    for r in found:
        classes[r.class_id].add(r.doc_id)
    assert all(c == {min(c), min(c) + 1} and min(c) % 2 == 0 for c in classes.values())
    assert len(classes) / 150 >= least


def test_repeated_passages(spark, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(60):
        line = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            line[rng.randrange(len(line))] = word()
        rows.append((i, "\n".join([" ".join(word() for _ in range(50)), " ".join(line), "short"]) if i % 3 else " ".join(word() for _ in range(70))))
    found = {(r.doc_id, r.paragraph): r.class_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = {(i, n): grams(x) for i, text in rows for n, x in enumerate(text.split("\n")) if len(x.split()) >= 45}
    words = {(i, n): x.split() for i, text in rows for n, x in enumerate(text.split("\n"))}
    near = lambda a, b: len(lines[a] & lines[b]) >= 0.8 * len(lines[a] | lines[b]) or distance(words[a], words[b]) <= max(len(words[a]), len(words[b])) // 10
    root = linked(sorted(lines), near)
    classes = defaultdict(set)
    for k, v in root.items():
        classes[v].add(k)
    want = {frozenset(c) for c in classes.values() if len({d for d, _ in c}) > 1}
    got = defaultdict(set)
    for k, v in found.items():
        got[v].add(k)
    assert {frozenset(c) for c in got.values()} == want and want
    assert repeated_passages(none).count() == 0
    assert all(r.n_words >= 45 for r in repeated_passages(odd).collect())


def test_similar_links_connect_all_that_are_similar():
    rng = random.Random(7)
    for _ in range(30):
        sets = []
        for _ in range(40):
            source = set(rng.choice(sets).tolist()) if sets and rng.random() < 0.7 else set(rng.sample(range(1000), 30))
            sets.append(np.array(sorted((source - set(rng.sample(sorted(source), 2))) | set(rng.sample(range(1000), rng.randrange(4)))), np.int32))
        jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9
        want, links = linked(range(40), jaccard), similar_links(sets)
        assert all(jaccard(a, b) for a, b in links)
        got = linked(range(40), lambda a, b: (a, b) in links or (b, a) in links)
        same = lambda r: {frozenset(k for k in r if r[k] == v) for v in r.values()}
        assert same(got) == same(want)


def test_edits_of_long_lists():
    """By diagonals, by bits, and by a few diagonals before bits: all as the whole table counts them."""
    rng = random.Random(12)
    for n, changes in ((70, 9), (300, 40), (1200, 30), (1200, 100)):
        a = [rng.randrange(60) for _ in range(n)]
        b = list(a)
        for _ in range(changes):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.randrange(60)] * rng.randrange(2)
        d = distance(a, b)
        assert d > 0 and [within_edits(x, y, most) for x, y in ((a, b), (b, a)) for most in (d - 1, d, d + 1)] == [False, True, True] * 2


def test_links_of_few_sets_connect_what_those_of_many_do(monkeypatch):
    """Buckets of texts, with words put in, left out and changed: compared at once, and in turn, against every pair."""
    rng = random.Random(9)
    for n in (2, 3, 12, 40):
        texts = []
        for _ in range(n):
            text = list(rng.choice(texts)) if texts and rng.random() < 0.7 else [rng.randrange(500) for _ in range(60)]
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.randrange(500)] * rng.randrange(2)
            texts.append(np.array(text, np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        sets = passages.shingle_sets(np.concatenate(texts), offsets)
        assert all((s == np.unique(passages.shingles(t, np.array([0, len(t)]))[0])).all() for s, t in zip(sets, texts, strict=True))
        near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) or distance(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j])) // 10
        same = lambda r: {frozenset(k for k in r if r[k] == v) for v in r.values()}
        want = same(linked(range(n), near))
        for at_once in (1 << 20, 0):
            monkeypatch.setattr(passages, "AT_ONCE", at_once)
            links = similar_links(sets, words=texts)
            assert all(near(i, j) for i, j in links)
            assert same(linked(range(n), lambda i, j: (i, j) in links or (j, i) in links)) == want


def adpcm_by_sample(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEP_SIZES[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.INDEX_STEPS[code])))
            out.append(value)
    return out


def test_audio(spark, odd, none, monkeypatch):
    assert len(audio.STEP_SIZES) == 89
    # known values of G.711
    assert [int(audio.MULAW[x]) for x in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(audio.ALAW[x]) for x in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    data = np.random.default_rng(1).integers(0, 256, 360, dtype=np.uint8)
    assert decode_adpcm(data).tolist() == [s for k in range(10) for s in adpcm_by_sample(data.tobytes()[36 * k : 36 * k + 36])]
    rows = documents_as_audio(odd, keep_media=True).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert len(rows) == len(texts)
    for text, r in zip(texts, rows):
        raw = text.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert audio.unwrap(bytes(r.media)) == ("mulaw", 8000, payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert len({(r.payload_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    pcm = decode_media(documents_as_audio(odd.limit(4), keep_media=True)).collect()
    assert all(len(r.pcm) == 4 * r.payload_bytes for r in pcm)
    assert documents_as_audio(none).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_postings_cover_all_shared_bytes():
    from itertools import combinations

    for order in (3, 4, 5):
        assert all(any(set(s) <= set(c) for s in postings(order)) for c in combinations(range(8), SHARED))


def test_simhash(spark, odd, none, monkeypatch):
    import traceloom.llm.simhash as m

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(15)]
    rows = []
    for i in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(300)] = word()
        rows.append((1000 - i, " ".join(words)))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = linked(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 16):
        monkeypatch.setattr(m, "BLOCK", block)
        out = near_duplicates(docs).collect()
        assert {r.doc_id: int(r.fingerprint, 16) for r in out} == prints
        assert {r.doc_id: r.component_id for r in out} == want
    out = near_duplicates(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in out) == sorted((r.doc_id is None, r.doc_id or 0, f"{brute_fingerprint(r.text):016x}") for r in odd.collect())
    assert near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}
