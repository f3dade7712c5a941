"""The tokenizer's automaton against the tokenizers library and against merging by rank."""

import hashlib
import random

import numpy as np
import pytest

from traceloom.llm import bpe
from traceloom.llm.bpe import Codec, Gadgets, Transitions, decode_ids, encode_texts, load_codec, round_trips
from traceloom.llm.packing import public_vocabulary

tokenizers = pytest.importorskip("tokenizers")
ALPHABETS = [list("ab"), list("aA 1.\n"), list("the inrowld "), [chr(i) for i in range(32, 127)], list("' sStTrevmld"), ["<|endoftext|>", " ", "\n", "a", "<", "|", ">"], list("é中😀  　\x1c \t")]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_vocabulary())


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def by_rank(word, merges, vocabulary):
    """Byte-pair encoding by its definition: the pair of lowest rank, wherever it stands, from left to right, until none is left."""
    parts = [bytes([b]) for b in word]
    rank = {}
    for i, pair in enumerate(merges):
        rank.setdefault(pair, i)
    while True:
        found = min((rank.get(pair, 1 << 30) for pair in zip(parts, parts[1:])), default=1 << 30)
        if found == 1 << 30:
            return [vocabulary[p] for p in parts]
        u, v = merges[found]
        out, i = [], 0
        while i < len(parts):
            both = i + 1 < len(parts) and (parts[i], parts[i + 1]) == (u, v)
            out.append(u + v if both else parts[i])
            i += 1 + both
        parts = out


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_equal_merging_by_rank(monkeypatch, seed):
    monkeypatch.setattr(bpe, "MOST_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "MOST_ARCS", 50)
    rnd = random.Random(seed)
    tokens, merges = [b"a", b"b", b"c"][: 2 + seed % 2], []
    while len(merges) < 25:
        pair = rnd.choice(tokens), rnd.choice(tokens)
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    vocabulary = {t: i for i, t in enumerate(tokens)}
    automaton = Transitions(Gadgets(vocabulary, merges))
    for _ in range(600):
        word = bytes(rnd.choice(tokens[: 2 + seed % 2])[0] for _ in range(rnd.randrange(1, 40)))
        assert automaton.encode(word) == by_rank(word, merges, vocabulary), word


def test_a_token_that_never_comes_about_and_one_made_twice():
    vocabulary = {t: i for i, t in enumerate((b"a", b"b", b"ba", b"ab", b"aba"))}
    merges = [(b"b", b"a"), (b"a", b"b"), (b"ab", b"a")]
    assert Transitions(Gadgets(vocabulary, merges)).encode(b"aba") == by_rank(b"aba", merges, vocabulary) == [0, 2]
    with pytest.raises(ValueError):
        Gadgets(vocabulary, [(b"a", b"b"), (b"b", b"a"), (b"ab", b"a"), (b"a", b"ba")])


def test_texts_equal_the_library(library):
    codec = load_codec(public_vocabulary())
    rnd = random.Random(5)
    for i in range(4000):
        text = "".join(rnd.choice(ALPHABETS[i % len(ALPHABETS)]) for _ in range(rnd.randrange(40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(codec, text) == want, text
        assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False) == text
    some = [0, 5, 255, 50256, 1000, 250, 101]
    assert codec.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_every_character_is_cut_as_the_library_cuts_it(library):
    codec = load_codec(public_vocabulary())
    texts = ["".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000) for start in range(0, 0x110000, 64)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids(codec, text) == want.ids, text


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 50_000 + "x", "ab" * 100_000, "=-" * 50_000, "thetheand" * 20_000])
def test_very_long_words(library, text):
    codec = load_codec(public_vocabulary())
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_little_memory_gives_the_same(library, monkeypatch):
    for name, most in (("MOST_TRANSITIONS", 20), ("MOST_ARCS", 10), ("MOST_RUNS", 3), ("LONGEST_KEPT", 4)):
        monkeypatch.setattr(bpe, name, most)
    real = load_codec(public_vocabulary())
    codec = Codec.__new__(Codec)
    codec.__dict__ = real.__dict__ | {"transitions": Transitions(real.transitions.gadgets)}
    codec.runs = bpe.Runs(codec._words)
    text = "Some of the words, and others: 1234 and so on,  twice. " * 3
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_round_trips_of_odd_rows(spark, odd, none, library):
    rows = round_trips(odd, public_vocabulary()).collect()
    want = []
    for r in odd.collect():
        found = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(found, skip_special_tokens=False)
        want.append((r.doc_id, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert round_trips(none, public_vocabulary()).count() == 0


def test_columns_of_ids_and_back(spark, odd):
    back = decode_ids(encode_texts(odd, public_vocabulary()), public_vocabulary(), text_col="again").collect()
    assert all(r.again == (r.text or "") and r.shard in ("b", None) for r in back)
