"""Secret scans by one deterministic automaton for all rules."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import compile_one, compile_rules, linked
from .shared import whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if it, or what follows its head, has at least `least` bytes.

    A pattern must not match longer than its longest match at each start, and must end where a run of
    one class of bytes ends; so the end of a run of accepting positions ends a leftmost match.
    """

    kind: str
    pattern: str
    least: int
    head: str | None = None
    base: bool = False


_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The base rules, then those that this method adds: formats that their issuers publish.
RULES = (
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 6, _HEAD, True),
    Rule("access", "AKIA[A-Z0-9]+", 20, None, True),
    Rule("hex", "[0-9a-f]{6,}", 24, None, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]*", 1),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
)


@functools.lru_cache(maxsize=4)
def arrays(rules: tuple[Rule, ...] = RULES):
    """The transition arrays of all rules together, of each rule backwards, and of its head. Built on the driver."""
    together = compile_rules([r.pattern for r in rules])
    return together, [(compile_one(r.pattern, True), compile_one(r.head) if r.head else None) for r in rules]


def load(rules: tuple[Rule, ...], built):
    """Arrays as linked states, which a worker steps through with one index a byte."""
    together, single = built
    return rules, linked(*together), [(r, linked(*back), linked(*head) if head else None) for r, (back, head) in zip(rules, single)]


def scan(data: bytes, scanner) -> list[tuple[int, int, int]]:
    """(start, end, rule number) of every secret, in bytes; leftmost and not overlapping within a rule.

    One pass of the combined automaton over the bytes finds where rules accept. Only from the ends
    of such runs does a rule's own automaton go back to the match's start.
    """
    _, state, single = scanner
    hits = []
    for i, byte in enumerate(data):
        state = state[byte]
        if state[256]:
            hits.append((i, state[256]))
    found = []
    for k, (rule, backwards, head) in enumerate(single):
        places = [i for i, bits in hits if bits >> k & 1]
        cursor = 0
        for n, last in enumerate(places):
            if n + 1 < len(places) and places[n + 1] == last + 1:
                continue
            state, start = backwards, None
            for i in range(last, cursor - 1, -1):
                state = state[data[i]]
                if state[256]:
                    start = i
                elif state[257]:
                    break
            if start is None:
                continue
            cursor, value = last + 1, start
            if head:
                state = head
                for i in range(start, last + 1):
                    state = state[data[i]]
                    if state[256]:
                        value = i + 1
                    elif state[257]:
                        break
                value = min(value, last)
            if last + 1 - value >= rule.least:
                found.append((start, last + 1, k))
    return sorted((s, e, k) for s, e, k in found)


def code_points(data: bytes, spans):
    """The spans, sorted by start, in code points."""
    out, at, passed = [], 0, 0
    for start, end, k in spans:
        passed += len(data[at:start].decode("utf-8", "replace"))
        at = start
        out.append((passed, passed + len(data[start:end].decode("utf-8", "replace")), k))
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count n_<kind> for each base rule, base_sha256, spans.

    spans lists kind:start:end in code points, by start, then by the order of rules; base_sha256 is
    the SHA-256 of that list for base rules alone. Null and empty texts have none. Repeated rows each
    have a row; an empty table gives no rows.
    """
    base = [r for r in rules if r.base]

    built = arrays(rules)

    def run(batches):
        scanner = load(rules, built)
        for batch in batches:
            columns = [[] for _ in range(len(base) + 2)]
            for text in batch.column(1):
                data = text.as_py().encode("utf-8", "replace")
                spans = code_points(data, scan(data, scanner))
                named = [f"{rules[k].kind}:{s}:{e}" for s, e, k in spans]
                plain = ",".join(x for x, (_, _, k) in zip(named, spans) if rules[k].base)
                for n, rule in enumerate(base):
                    columns[n].append(sum(rules[k] is rule for _, _, k in spans))
                columns[-2].append(hashlib.sha256(plain.encode()).hexdigest())
                columns[-1].append(",".join(named))
            kinds = [pa.int64()] * len(base) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)

    names = ["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "spans"]
    schema = ", ".join(["doc_id long", *(f"n_{r.kind} long" for r in base), "base_sha256 string", "spans string"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with every secret in text_col replaced by [KIND]; overlapping secrets become one mark. Null stays null."""

    built = arrays(rules)

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = load(rules, built)
        for texts in parts:
            yield texts.map(lambda t: redacted(t, scanner))

    return docs.withColumn(text_col, clean(text_col))


def redacted(text, scanner):
    if text is None:
        return None
    data = text.encode("utf-8", "replace")
    spans = scan(data, scanner)
    if not spans:
        return text
    out, at = [], 0
    for start, end, k in spans:
        if start >= at:
            out += [data[at:start], f"[{scanner[0][k].kind.upper()}]".encode()]
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode("utf-8")
