"""Repeated passages: paragraph MinHash banding, exact Jaccard or edit distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runs import shared_runs
from .shared import Workspace, ascii_lower, whole_text
from .simhash import _with_end

#: Words of a shingle, the Jaccard similarity of near-duplicates, the part of the words that may differ instead, and words of a paragraph at least.
SHINGLE, SIMILAR, EDITS, LEAST_WORDS = 5, 0.8, 0.1, 45
#: Bands of rows. Of 60 words with one to five changed, a pair meets in one of 12 bands of 2 with probability 1, 1, 0.98, 0.94 and 0.84.
BANDS, ROWS = 12, 2
#: Paragraphs of one bucket that one task compares; larger buckets are compared in blocks.
BLOCK = 2048
#: Shingles whose minima are taken at a time, or which are sorted at a time.
CHUNK = 1 << 18
#: Sets times their members, up to which all pairs of sets are counted at once.
AT_ONCE = 1 << 20
#: Words of the longer list, beyond which FEW edits are tried before all are counted.
LONG, FEW = 1024, 64


def paragraph_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, paragraph (line number from 0), n_words, id, words (32-bit hashes) of lines with LEAST_WORDS words."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(whole_text(text_col), "\n")).alias("paragraph", "line"))
    words = F.filter(F.split(ascii_lower(F.col("line")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # a line shorter than its words and the blanks between them needs no split
    # explode() of one: else Spark would split for the filter, and again for the rows
    worded = lines.filter(F.length("line") >= 2 * LEAST_WORDS - 1).select("doc_id", "paragraph", F.explode(F.array(words)).alias("words")).filter(F.size("words") >= LEAST_WORDS)
    hashes = F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return worded.select("doc_id", "paragraph", F.size("words").alias("n_words"), F.xxhash64("words").alias("id"), hashes.alias("words"))


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of SHINGLE words of each list, and their offsets; lists have at least that many words."""
    each = np.diff(offsets)
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    runs = max(len(words) - SHINGLE + 1, 0)
    out = np.zeros(runs, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + runs]
    out ^= out >> np.uint64(29)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], each)
    whole = place < np.repeat(each - (SHINGLE - 1), each)
    return out[whole[:runs]], np.concatenate([[0], np.cumsum(each - (SHINGLE - 1))])


def cuts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Lists a to b of about CHUNK members at a time, lists whole."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b
        a = b


def shingle_sets(words: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The shingles of each list, sorted and without repeats."""
    sets = []
    for a, b in cuts(offsets):
        values, at = shingles(words[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        of = np.repeat(np.arange(b - a), np.diff(at))
        order = np.lexsort((values, of))
        values = values[order]
        fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])])
        sets += np.split(values[fresh], np.cumsum(np.bincount(of[fresh], minlength=b - a))[:-1])
    return sets


def band_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key for each band of each run of shingle hashes: a mix of its minima under ROWS seeded permutations."""
    rng = np.random.default_rng(17)
    factor = rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
    keys = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    for a, b in cuts(offsets):
        part, starts = values[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        for k in range(BANDS * ROWS):
            mixed = part * factor[k] + shift[k]
            least = np.minimum.reduceat(mixed >> np.uint64(20), starts)
            keys[a:b, k // ROWS] = (keys[a:b, k // ROWS] ^ least) * np.uint64(0xD6E8FEB86659FD93)
            keys[a:b, k // ROWS] ^= keys[a:b, k // ROWS] >> np.uint64(32)
    return keys


def with_bands(worded: DataFrame) -> DataFrame:
    names = [f.name for f in worded.schema]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(names.index("words"))
            offsets = np.asarray(lists.offsets, np.int64)
            words = np.asarray(lists.values)[offsets[0] : offsets[-1]]
            keys = band_keys(*shingles(words, offsets - offsets[0])).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, bands], names=[*names, "bands"])

    return worded.mapInArrow(run, "doc_id long, paragraph int, n_words int, id long, words array<int>, bands array<long>")


def within_edits(a: list, b: list, most: int) -> bool:
    """Whether at most `most` insertions, deletions and changes make a into b.

    In long lists, it is first seen how far each diagonal gets with 0, 1, 2... edits, which is soon done if few are enough.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    if not n or not m or n == m and sum(map(ne, a, b)) <= most:
        return True
    few = min(most, FEW) if max(n, m) > LONG else -1
    reached: dict[int, int] = {}
    for edits in range(few + 1):
        now = {}
        for d in range(-edits, edits + 1):
            i = 0 if not edits else max(reached.get(d, -2) + 1, reached.get(d - 1, -2), reached.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            if i == n and i + d == m:
                return True
            now[d] = i
        reached = now
    return few < most and _within_bits(a, b, most)


def _within_bits(a: list, b: list, most: int) -> bool:
    """The same by bits: where a column of the table of distances rises and falls from one word of a to the next (Myers; Hyyro)."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance, left = every, 0, len(a), len(b)
    for x in b:
        same = places.get(x, 0)
        across = ((same & up) + up ^ up) | same
        rise, fall = (down | ~(across | up)) & every, up & across
        left -= 1
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        if distance - left > most:
            return False
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(same | down | rise)) & every, rise & (same | down)
    return distance <= most


def _links_at_once(sets: list[np.ndarray], least: float, words: list[np.ndarray] | None, edits: float) -> list[tuple[int, int]]:
    """similar_links of few and small sets: the members that all pairs share are one product of matrices."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    members, column = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((n, len(members)), np.float32)
    held[np.repeat(np.arange(n), sizes), column] = 1
    shared = (held @ held.T).astype(np.int64)
    near = shared >= least * (sizes[:, None] + sizes - shared) - 1e-9
    root, found = list(range(n)), []

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        if (x := top(i)) != (y := top(j)):
            root[y] = x
            found.append((i, j))
    if words is None or len(found) == n - 1:
        return found
    counts = np.array([len(w) for w in words])
    allowed = np.floor(np.maximum(counts[:, None], counts) * edits + 1e-9).astype(np.int64)
    maybe = ~near & (np.abs(counts[:, None] - counts) <= allowed) & (shared >= np.maximum(sizes[:, None], sizes) - SHINGLE * allowed)
    lists: dict = {}
    for i, j in np.argwhere(np.triu(maybe, 1)).tolist():
        if (x := top(i)) != (y := top(j)):
            for k in (i, j):
                if k not in lists:
                    lists[k] = words[k].tolist(), set(words[k].tolist())
            (a, known_a), (b, known_b), most = lists[i], lists[j], int(allowed[i, j])
            # a word that only one has is an edit
            if len(known_a - known_b) <= most and len(known_b - known_a) <= most and within_edits(a, b, most):
                root[y] = x
                found.append((i, j))
    return found


def similar_links(sets: list[np.ndarray], least: float = SIMILAR, words: list[np.ndarray] | None = None, edits: float = EDITS) -> list[tuple[int, int]]:
    """Links (i, j) of sets whose Jaccard similarity is at least `least`, enough to connect all that are.

    With the words of which they are the shingles, also of those of which at most the part `edits` of the longer one's
    words was inserted, deleted or changed. Every set in turn is compared with all that are not yet known to be
    connected to it, by one pass over their members; sets of the largest connected part come last, when little is
    left outside. An edit changes SHINGLE shingles at most, so few pairs are left for the distance itself.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n and n * int(sizes.sum()) <= AT_ONCE:
        return _links_at_once(sets, least, words, edits)
    if words is not None:
        counts, words = np.array([len(w) for w in words]), [w.tolist() for w in words]
        known = [set(w) for w in words]
    flat = np.concatenate(sets) if n else np.empty(0, np.int32)
    owner = np.repeat(np.arange(n), sizes)
    root, done, found = np.arange(n), np.zeros(n, bool), []
    order = np.argsort(flat, kind="stable")
    sorted_, owners = flat[order], owner[order]
    for turn in range(n):
        part = np.bincount(root, minlength=n)
        waiting = np.flatnonzero(~done)
        i = int(waiting[0] if turn == 0 else waiting[part[root[waiting]].argmin()])
        done[i] = True
        if part[root[i]] == n or (done | (root == root[i])).all() and not (~done & (root != root[i])).any():
            continue
        low, high = np.searchsorted(sorted_, sets[i], "left"), np.searchsorted(sorted_, sets[i], "right")
        shared = np.bincount(np.concatenate([owners[a:b] for a, b in zip(low, high)]), minlength=n)
        near = (shared >= least * (sizes[i] + sizes - shared) - 1e-9) & (root != root[i])
        partners = np.flatnonzero(near).tolist()
        if words is not None:
            allowed = np.floor(np.maximum(counts, counts[i]) * edits + 1e-9).astype(np.int64)
            maybe = ~near & (root != root[i]) & (np.abs(counts - counts[i]) <= allowed) & (shared >= np.maximum(sizes, sizes[i]) - SHINGLE * allowed)
            joined = set(root[partners].tolist())  # a partner's whole part is connected with it, so one of a part is enough
            for j, most in zip(np.flatnonzero(maybe).tolist(), allowed[maybe].tolist()):
                # a word that only one has is an edit
                if root[j] not in joined and len(known[i] - known[j]) <= most and len(known[j] - known[i]) <= most and within_edits(words[i], words[j], most):
                    partners.append(j)
                    joined.add(int(root[j]))
        for j in partners:
            found.append((i, j))
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
    return found


def verified_links(clusters: DataFrame) -> DataFrame:
    """clusters(cluster, n, id, words): links (a, b) of ids of a bucket with exact Jaccard similarity of at least SIMILAR, or at most the part EDITS of their words apart."""
    dealt = clusters.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"), "id", "words")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        key, ids, sets, texts = None, [], [], []
        for batch in _with_end(batches):
            rows, found = [(None, 0, None, None)], []
            if batch is not None:
                offsets = np.asarray(batch.column(4).offsets, np.int64)
                words, offsets = np.asarray(batch.column(4).values)[offsets[0] : offsets[-1]], offsets - offsets[0]
                rows = zip(zip(*(batch.column(k).to_pylist() for k in range(3))), batch.column(3).to_pylist(), np.split(words, offsets[1:-1]), shingle_sets(words, offsets))
            for now, one, text, members in rows:
                if now != key:
                    if len(ids) > 1:
                        found += [(ids[i], ids[j]) for i, j in similar_links(sets, words=texts)]
                    key, ids, sets, texts = now, [], [], []
                if now is not None:
                    ids.append(one)
                    texts.append(text)
                    sets.append(members)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], schema=schema)

    order = ["cluster", "b1", "b2"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs (lines of at least LEAST_WORDS words) that occur in several documents, exactly or nearly.

    Near means a Jaccard similarity of at least 0.8 of their five-word shingles, or at most a tenth of the longer
    one's words inserted, deleted or changed, or a chain of such paragraphs. Returns, for each occurrence, doc_id, paragraph (line from 0), n_words, class_id,
    occurrences (of the class), kept (true for the first by doc_id and line; the others are the
    removals). Documents without such a paragraph have no row. Case of A to Z and blanks don't count.
    Null and empty texts have no paragraphs. Repeated rows count as documents only by their ids: a
    class must have two of them, and null ids don't count. An empty table gives no rows. Equal
    paragraphs are known by 64-bit hashes and meet before any comparison.
    """
    ws = Workspace(docs.sparkSession)
    marked = ws.save(with_bands(paragraph_words(docs, id_col, text_col)))
    where = marked.select("doc_id", "paragraph", "n_words", "id")
    keys = ws.save(marked.groupBy("id").agg(F.first("bands").alias("bands")))  # equal paragraphs have equal bands
    index = keys.select("id", F.posexplode("bands").alias("band", "key"))
    met = index.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum")).filter("n > 1")
    # near copies meet in most bands: of the buckets with the same members, one is compared
    buckets = ws.save(met.groupBy("n", "least", "most", "sum").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key", "n"))
    members = ws.save(index.join(buckets, ["band", "key"]).select(F.xxhash64("band", "key").alias("cluster"), "n", "id"))
    ws.drop(keys)
    words = marked.select("id", "words").join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("words").alias("words"))
    links = ws.save(verified_links(members.join(words, "id")))
    ws.drop(members)
    near = ws.save(components(links).select(F.col("node").alias("id"), "component"))
    occurrence = where.join(near, "id", "left").withColumn("class_id", F.coalesce("component", "id"))
    occurrence = ws.save(occurrence.select("doc_id", "paragraph", "n_words", "class_id"))
    ws.drop(marked)
    classes = occurrence.groupBy("class_id").agg(F.count("*").alias("occurrences"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "paragraph")).alias("first")).filter("low < high")
    joined = occurrence.join(classes, "class_id")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph"))
    return joined.select("doc_id", "paragraph", "n_words", "class_id", "occurrences", kept.alias("kept"))


def repeated_passages_and_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of repeated_passages, with first_word null, and those of shared_runs.

    So passages that are wrapped, span lines or stand inside longer lines are found where 50 words are equal.
    A run is listed also where it lies in a repeated line; either row may tell to remove it.
    """
    lines = repeated_passages(docs, id_col, text_col)
    return lines.withColumn("first_word", F.lit(None).cast("long")).unionByName(shared_runs(docs, id_col, text_col))
