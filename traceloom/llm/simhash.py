"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BATCH, Workspace, ascii_lower, join_groups, whole_text

#: Bits in which linked fingerprints may differ; bytes of 8 that they then surely share.
DISTANCE = 3
SHARED = 8 - DISTANCE
#: Fingerprints of one posting that one task compares; longer postings are compared in blocks.
BLOCK = 4096
#: Shingle hashes whose bits are counted at a time.
CHUNK = 100_000


def shingle_hashes(text, words: int = 3):
    """XXH64 (seed 42) of each word shingle of the lower-cased text, as an array column expression.

    Needs two steps, as the words are used more than once: returns functions (frame -> frame).
    """
    split = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def with_hashes(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("_words", split)
        runs = F.arrays_zip(*[F.slice("_words", k + 1, F.greatest(F.size("_words") - (words - 1), F.lit(0))).alias(f"w{k}") for k in range(words)])
        hashes = F.transform(runs, lambda r: F.xxhash64(F.concat_ws(" ", *[r[f"w{k}"] for k in range(words)])))
        few = F.size("_words").between(1, words - 1)
        return frame.withColumn("_hashes", F.when(few, F.array(F.xxhash64(F.array_join("_words", " ")))).otherwise(hashes)).drop("_words")

    return with_hashes


def _majority(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: bits set in over half of them; a run without any has 0."""
    out = np.zeros(len(starts), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def counts(part):
        return np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    d = 0
    while d < len(starts):
        last = d  # as many short runs as fit a chunk, or one long run in chunks
        while last + 1 < len(starts) and ends[last + 1] - starts[d] <= CHUNK:
            last += 1
        if last == d:
            total = np.zeros(64, np.int64)
            for k in range(starts[d], ends[d], CHUNK):
                total += counts(hashes[k : min(k + CHUNK, ends[d])]).sum(0, dtype=np.int64)
            out[d] = (weight * (2 * total > ends[d] - starts[d])).sum(dtype=np.uint64)
        else:
            full = np.flatnonzero(ends[d : last + 1] > starts[d : last + 1]) + d
            if len(full):
                total = np.add.reduceat(counts(hashes[starts[d] : ends[last]]), starts[full] - starts[d], axis=0, dtype=np.int32)
                out[full] = (weight * (2 * total > (ends[full] - starts[full])[:, None])).sum(1, dtype=np.uint64)
        d = last + 1
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document."""

    def count(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            values = np.ascontiguousarray(np.asarray(lists.values.fill_null(0), dtype=np.int64)).view(np.uint64)
            fp = _majority(values, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    hashed = shingle_hashes(whole_text(text_col), words)(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col))
    return hashed.select("doc_id", F.col("_hashes")).mapInArrow(count, "doc_id long, fp long")


@lru_cache
def postings(order: int) -> tuple[tuple[int, ...], ...]:
    """Sets of `order` byte positions such that any SHARED of the 8 positions contain one of them."""
    need = set(combinations(range(8), SHARED))
    if order == 3:  # of five positions, three lie in the same half
        return tuple(s for half in (range(4), range(4, 8)) for s in combinations(half, 3))
    chosen = []
    while need:
        best = max(combinations(range(8), order), key=lambda s: (sum(set(s) <= set(n) for n in need), [-x for x in s]))
        chosen.append(best)
        need = {n for n in need if not set(best) <= set(n)}
    return tuple(chosen)


def _links(keys: np.ndarray, fps: np.ndarray):
    """Spanning links of rows sorted by key: pairs with equal key that share SHARED bytes and differ in at most DISTANCE bits."""
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found, live, lag = [], np.arange(len(fps)), 1
    while True:
        live = live[live + lag < len(fps)]
        live = live[keys[live] == keys[live + lag]]
        if not len(live):
            return found
        differ = fps[live] ^ fps[live + lag]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # the tally of positional bytes
        near = live[(shared >= SHARED) & (np.bitwise_count(differ) <= DISTANCE) & (root[live] != root[live + lag])]
        for i in near.tolist():
            a, b = find(i), find(i + lag)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(fps[i]), int(fps[i + lag])))
        if len(near):
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        lag += 1


def near_links(distinct: DataFrame) -> DataFrame:
    """distinct(fp): edges (a, b) that connect all fingerprints within DISTANCE bits, and only those.

    Fingerprints within three bits share five of eight bytes at their positions. The inverted index
    has postings for sets of positions, small enough that any five shared ones include a set, and so
    large (three bytes up to 2^24 fingerprints, four up to 2^32, then five) that unrelated
    fingerprints rarely meet. Within a posting, the shared bytes of pairs are tallied, pairs below
    the minimum go, and the rest are verified. Only links that connect something new are returned,
    fewer than the fingerprints of a posting. A posting of more than BLOCK is cut by the further
    positions that its pairs must share; what is still long is dealt into blocks, compared two by two.
    """
    ws = Workspace(distinct.sparkSession)
    n = distinct.count()
    sets = postings(3 if n <= 1 << 24 else 4 if n <= 1 << 32 else 5)

    def mask(positions):
        bits = sum(0xFF << 8 * p for p in positions)
        return F.lit(bits - (1 << 64) if bits >> 63 else bits)

    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(mask(s)).alias("key")) for i, s in enumerate(sets)]))
    index = distinct.select("fp", entries.alias("e")).select("fp", "e.s", "e.key")
    sizes = lambda rows: rows.groupBy("s", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = ws.save(sizes(index))
    of = index.join(met, ["s", "key"])
    if len(sets[0]) < SHARED and not met.filter(F.col("n") > BLOCK).isEmpty():
        # pairs of a long posting share further positions: these cut it into smaller ones, all of SHARED positions
        further = [[sorted({*s, *more}) for more in combinations(sorted(set(range(8)) - set(s)), SHARED - len(s))] for s in sets]
        masks = F.element_at(F.array(*[F.array(*map(mask, each)) for each in further]), F.col("s") + 1)
        number = len(sets) + F.col("s") * F.lit(len(further[0])) + F.col("c")
        finer = of.filter(F.col("n") > BLOCK).select("fp", "s", F.posexplode(masks).alias("c", "m")).select("fp", number.alias("s"), F.col("fp").bitwiseAND(F.col("m")).alias("key"))
        of = of.filter(F.col("n") <= BLOCK).unionByName(finer.join(ws.save(sizes(finer)), ["s", "key"]))
    dealt = of.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("s", "key", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"), "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        kept = None
        for batch in _with_end(batches):
            if batch is not None:
                table = np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], 1)
                kept = table if kept is None else np.concatenate([kept, table])
            if kept is None or not len(kept):
                continue
            change = np.flatnonzero((kept[1:, :4] != kept[:-1, :4]).any(1)) + 1
            cut = len(kept) if batch is None else (change[-1] if len(change) else 0)
            ready, kept = kept[:cut], kept[cut:]
            if len(ready):
                number = np.zeros(len(ready), np.int64)
                number[change[change < cut]] = 1
                found = _links(np.cumsum(number), np.ascontiguousarray(ready[:, 4]).view(np.uint64))
                pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    order = ["s", "key", "b1", "b2"]
    return ws.save(dealt.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(compare, "a long, b long"))


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Documents with equal fingerprints are linked; the search runs over distinct fingerprints. Null,
    empty and blank texts have fingerprint zero; texts of fewer words than a shingle are one shingle.
    Repeated rows each have a row. A null doc_id never names a component, unless all its members
    are null. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    marked = ws.save(fingerprints(docs, id_col, text_col, words), BATCH)
    distinct = ws.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    nodes = ws.save(components(near_links(distinct.select("fp"))))
    member = nodes.join(distinct, nodes["node"] == distinct["fp"]).select("fp", "component", "first")
    least = member.groupBy("component").agg(F.min("first").alias("least"))
    of = member.join(least, "component").select("fp", "least")
    named = ws.save(distinct.join(of, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"))
    return join_groups(marked, named, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
