"""Byte-pair encoding by a deterministic automaton, compiled from the merges gadget by gadget.

Start from the automaton of one state that accepts all strings of bytes, an arc a byte. The merge (u, v) -> w
puts this gadget into it: the state behind u's arcs becomes one of its own and loses its arc v; every state with
an arc u gets an arc w, to a state like v's. After the last merge a path spells a string of bytes in just one
way, as byte-pair encoding cuts it. A state is named by the token of the arcs that enter it.

The automaton of 50,000 merges has 2.5 thousand million possible arcs, so states and arcs are copied on demand:
a gadget writes down what it copies and when (`Gadgets`), and `arc` follows the copies back. Read byte by byte
(`Transitions`) the automaton becomes one whose states are the cuts still open; its table of transitions is
filled as texts need them, and each of its states has the label of the last arc. Encoding is one look-up a byte,
then the labels from the end backwards; decoding writes each arc's label, the token's bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole_text

#: Transitions, arcs and runs of text that a worker keeps; beyond it they are forgotten and made anew.
MOST_TRANSITIONS, MOST_ARCS, MOST_RUNS = 600_000, 1_000_000, 700_000
#: Longer runs of text are not kept.
LONGEST_KEPT = 48
#: How byte-level tokenizers cut a text into words; white space is Unicode's property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Marks that often end a word.
ENDS = frozenset(",.;:!?")
START = -1


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Gadgets:
    """The automaton over tokens: what each merge's gadget copied and took away."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.label[i] = token
        self.left, self.right, self.made, self.hole, self.dead = {}, {}, {}, {}, set()
        self.known: dict[int, bool] = {}
        for time, (u, v) in enumerate(merges, 1):
            self.gadget(time, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self.end = 3 * len(merges) + 3

    def gadget(self, time: int, u: int, v: int, w: int) -> None:
        """(u, v) -> w: arc v goes from the state behind u; w's state is a copy of v's, w's arcs stand where u's do.

        Where u has no arc v by now, earlier merges always part them otherwise, and w never comes about.
        """
        if (u, v) in self.hole:
            return
        if w in self.made or w in self.dead:
            raise ValueError(f"two merges make the token {self.label[w]!r}")
        if u in self.dead or v in self.dead or not self.arc_at(u, v, 3 * time):
            self.dead.add(w)
            return
        self.hole[u, v] = time
        self.left[w], self.right[w], self.made[w] = u, v, time

    def arc_at(self, a: int, b: int, moment: int) -> bool:
        """Whether the state behind a has an arc b at that moment.

        A gadget does three things, in this order: it copies the state, takes the arc away, copies the arcs.
        Moments are therefore 3 * time, plus 0, 1 or 2. The younger of the two is traced back to what it was copied from.
        """
        while True:
            hole = self.hole.get((a, b))
            if hole is not None and 3 * hole + 1 < moment:
                return False
            born, arcs_born = self.made.get(a, 0), self.made.get(b, 0)
            if not born and not arcs_born:
                return True
            if arcs_born >= born:
                b, moment = self.left[b], 3 * arcs_born + 2
            else:
                a, moment = self.right[a], 3 * born

    def arc(self, x: int, y: int) -> bool:
        """Whether the state behind x has an arc y when all gadgets are in."""
        key = x << 32 | y
        there = self.known.get(key)
        if there is not None:
            return there
        there = self.arc_at(x, y, self.end)
        if len(self.known) >= MOST_ARCS:
            self.known.clear()
        self.known[key] = there
        return there


class Transitions:
    """The automaton over bytes: a table of next states, and for each state the label of the arc that ends there."""

    def __init__(self, gadgets: Gadgets):
        self.gadgets = gadgets
        self.child: dict[int, int] = {}
        self.token = [START]
        for i, label in enumerate(gadgets.label):
            if i in gadgets.dead:
                continue
            node = 0
            for byte in label:
                node = self.child.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(START)
            if label:
                self.token[node] = i
        self.length = [len(label) for label in gadgets.label]
        self.forget()

    def forget(self) -> None:
        self.states = [((START, 0),)]
        self.number = {self.states[0]: 0}
        self.table: list[dict[int, int]] = [{}]
        self.last = [START]
        self.size = 0

    def grow(self, state: int, byte: int) -> int:
        """The transition that the table lacks: every open cut reads the byte; the one that ends a token opens the next."""
        child, token_at, arc = self.child, self.token, self.gadgets.arc
        still, last = [], START
        for cut in self.states[state]:
            node = child.get(cut[1] << 8 | byte)
            if node is not None:
                still.append((cut[0], node))
                if last == START and token_at[node] != START and (cut[0] == START or arc(cut[0], token_at[node])):
                    last = token_at[node]  # no other cut ends here, as there is one path a string
        if last == START:
            raise ValueError(f"no token ends with the byte {byte}")
        still.append((last, 0))
        cuts = tuple(still)
        number = self.number.setdefault(cuts, len(self.states))
        if number == len(self.states):
            self.states.append(cuts)
            self.table.append({})
            self.last.append(last)
        self.table[state][byte] = number
        self.size += 1
        return number

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word, in time that grows with its length alone."""
        if self.size >= MOST_TRANSITIONS:
            self.forget()
        table, last, state, ends = self.table, self.last, 0, []
        for byte in word:
            try:
                state = table[state][byte]
            except KeyError:
                state = self.grow(state, byte)
            ends.append(last[state])
        ids, at, length = [], len(word), self.length
        while at:
            ids.append(ends[at - 1])
            at -= length[ids[-1]]
        return ids[::-1]


class Runs(dict):
    """The ids, as bytes, of a space and the run of text after it, up to the next space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        word, mark = run[:-1], run[-1:]
        if mark in ENDS and word.isalpha():  # a word and a mark after it are words of their own
            packed = self[word] + self.encode(mark)
        else:
            packed = self.encode(" " + run)
        if len(run) <= LONGEST_KEPT:
            if len(self) >= MOST_RUNS:
                self.clear()
            self[run] = packed
        return packed


class Codec:
    """Texts to ids and back: special tokens, words, and the automaton on each word."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        import regex

        self.transitions = Transitions(Gadgets(vocabulary, merges))
        self.special = special
        self.labels = {i: label for label, i in vocabulary.items()} | {i: text.encode() for text, i in special.items()}
        self.words = regex.compile(WORDS)
        self.double = regex.compile(f"[{SPACE}][{SPACE}]")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.packed = {i: i.to_bytes(4, "little") for i in self.labels}
        self.runs = Runs(self._words)

    def _words(self, run: str) -> bytes:
        words = (run,) if run[1:].isalpha() and run[0] == " " else self.words.findall(run)
        encode, packed = self.transitions.encode, self.packed
        return b"".join([packed[i] for word in words for i in encode(word.encode())])

    def _plain(self, text: str) -> bytes:
        """A space between two other characters always starts a word, so the runs between such spaces are independent, and are kept."""
        if self.double.search(text):
            return self._words(text)
        first, *others = text.split(" ")
        return self._words(first) + b"".join(map(self.runs.__getitem__, others))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.cut or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self._plain(text[at : found.start()]), self.special[found.group()].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after another; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    """The codec of a byte-level vocabulary file of the tokenizers library; compiled once a worker."""
    with open(path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    letters = byte_letters()

    def as_bytes(token: str) -> bytes:
        return bytes(map(letters.__getitem__, token))

    special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
    vocabulary = {as_bytes(token): i for token, i in tokenizer["model"]["vocab"].items() if token not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in tokenizer["model"]["merges"])
    return Codec(vocabulary, [(as_bytes(u), as_bytes(v)) for u, v in pairs], special)


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trips(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, then decoded from these ids.

    A row of the result for each row, whatever its id; a null text is empty: no ids, both digests those of no bytes.
    Nothing is shuffled; further columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(batches):
        codec = load_codec(vocabulary)
        for batch in batches:
            counts, ids_digests, decoded = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(digests, ROUND_TRIP)


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The input's columns and `ids_col`, an array of ids; a null text has no ids (an empty array)."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = load_codec(vocabulary)
        return texts.map(lambda text: np.frombuffer(codec.encode(text), "<u4").astype("int32"))

    return docs.withColumn(ids_col, ids(whole_text(text_col)))


def decode_ids(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The input's columns and `text_col`, the text of the ids; null ids give a null text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = load_codec(vocabulary)
        return ids.map(lambda row: None if row is None else codec.decode(np.asarray(row, "<u4").tobytes()))

    return tokens.withColumn(text_col, text(ids_col))
