"""Ranked lexical search with inverted treaps.

A term's postings form a treap: in doc_id order as a search tree, by impact (what the term adds to a document's
score) as a heap. A query walks the treaps of its terms together, range of documents by range. The root of a
treap within a range has the largest impact there, so the roots' sum bounds every score of the range, and ranges
whose bound cannot enter the k best are left out, subtrees and all. The walk splits a range at the document of
its heaviest root; ranges of few postings are summed up at once.

Spark deals the documents: a task builds treaps over its own documents, segment by segment, keeps the k best of
every query from one segment to the next, and returns only these; a window merges the tasks' lists.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, ascii_lower, whole_text

#: Results of a query; postings of a segment of treaps; postings of ranges that are summed up at once; ranges that are split together.
TOP, SEGMENT, SMALL, TOGETHER = 10, 1 << 20, 4096, 64
#: Query terms, with repeats, that go to the tasks at a time. More queries take further passes over the documents.
BLOCK_TERMS = 1 << 18
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in UTF-8: A to Z in lower case, the other ASCII characters that are in no term as spaces.
_FOLDED = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FULL, GAIN, FLAT = 1_000_000_000, 1000, 75
#: Low bits of a heap key, by which equal impacts stand in an order of their own, so that ties make no long chains.
TIE_BITS = 20


def terms(text) -> F.Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def split_terms(text: str | None) -> list[bytes]:
    """The same terms, in Python, as UTF-8."""
    return (text or "").encode().translate(_FOLDED).split()


def statistics(docs: DataFrame, wanted: DataFrame, text_col: str) -> tuple[DataFrame, int, int]:
    """(term, df) of the wanted terms, N and L. Counts are added up within tasks first, so no term is a hot key."""
    found = terms(whole_text(text_col))
    each = F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("n")))
    whole = F.array(F.struct(F.lit("").alias("term"), F.size(found).cast("long").alias("n")))
    ws = Workspace(docs.sparkSession)
    counted = docs.select(F.explode(F.concat(each, whole)).alias("e")).groupBy("e.term").agg(F.sum((F.col("e.n") > 0).cast("long")).alias("df"), F.sum("e.n").alias("n"))
    # the empty term stands for whole texts
    kept = ws.save(counted.join(wanted.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi"))
    row = kept.filter("term = ''").first()
    return kept.filter("term <> ''").select("term", "df"), row["df"] if row else 0, row["n"] if row else 0


class Treaps:
    """The treaps of one segment, in arrays over postings sorted by (term, document): a subtree is a slice."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        self.docs = int(self.doc.max()) + 1
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        heap = (self.impact << TIE_BITS) | (self.doc * 0x9E3779B1 & (1 << TIE_BITS) - 1)
        self.slice: dict[int, tuple[int, int, int]] = {}  # of a term: root, start, stop
        left, right = [-1] * len(term), [-1] * len(term)
        key = heap.tolist()
        for name, start, stop in zip(term[at].tolist(), at.tolist(), [*at[1:].tolist(), len(term)]):
            spine: list[int] = []  # the right edge of the treap so far, from the root down
            for i in range(start, stop):
                below = -1
                while spine and key[spine[-1]] < key[i]:
                    below = spine.pop()
                left[i] = below
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            self.slice[name] = spine[0], start, stop
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def root_within(self, node: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """From each node down to the first one in its slice, which is the root of the slice; -1 if the slice is empty."""
        node = node.copy()
        out = np.flatnonzero((node >= 0) & ((node < start) | (node >= stop)))
        while len(out):
            n = node[out]
            node[out] = n = np.where(n < start[out], self.right[n], self.left[n])
            out = out[(n >= 0) & ((n < start[out]) | (n >= stop[out]))]
        return node

    def place_of(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where each document stands, or would stand, among the postings below the node: the search for it."""
        place = np.zeros_like(node)
        todo = np.flatnonzero(node >= 0)
        n = node[todo]
        while len(todo):
            less, same = self.doc[n] < doc[todo], self.doc[n] == doc[todo]
            place[todo] = n + less
            n = np.where(less, self.right[n], self.left[n])
            go = ~same & (n >= 0)
            todo, n = todo[go], n[go]
        return place

    def split(self, node: np.ndarray, start: np.ndarray, stop: np.ndarray, doc: np.ndarray):
        """The slices before and after `doc`, as arrays like the given, and the impact at it. Arrays are by (range, term)."""
        shape = node.shape
        node, start, stop, doc = node.ravel(), start.ravel(), stop.ravel(), np.repeat(doc, shape[1])
        place = np.where(node >= 0, self.place_of(node, doc), start)
        hit = (place < stop) & (self.doc[np.minimum(place, len(self.doc) - 1)] == doc)
        after = place + hit
        sides = (self.root_within(node, start, place), start, place), (self.root_within(node, after, stop), after, stop)
        return *(tuple(x.reshape(shape) for x in side) for side in sides), np.where(hit, self.impact[np.minimum(place, len(self.doc) - 1)], 0).reshape(shape)

    def sums(self, start: np.ndarray, stop: np.ndarray, times: np.ndarray):
        """(documents, scores) of all postings of the slices, by (range, term)."""
        length = (stop - start).ravel()
        posting = np.repeat(start.ravel() - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        scores = np.zeros(self.docs, np.int64)
        np.add.at(scores, self.doc[posting], self.impact[posting] * np.repeat(np.tile(times, len(start)), length))
        found = np.flatnonzero(scores)
        return found, scores[found]

    def search(self, query: list[tuple[int, int]], best: list, k: int, ids: list) -> None:
        """Put this segment's documents into `best`, the k best (score descending, then ids) of a query of (term, times)."""
        present = [(*self.slice[t], times) for t, times in query if t in self.slice]
        if not present:
            return
        node, start, stop, times = np.array(present, np.int64).T
        ranges = [(0, 0, np.stack([node, start, stop]))]
        made = 0

        def least() -> int:
            return -best[-1][0] if len(best) >= k else 1

        def enter(docs: np.ndarray, scores: np.ndarray) -> None:
            keep = scores >= least()
            docs, scores = docs[keep], scores[keep]
            best.extend((-int(scores[i]), *ids[docs[i]]) for i in np.lexsort((docs, -scores))[:k])
            best.sort()
            del best[k:]

        while ranges:
            taken = []
            while ranges and len(taken) < TOGETHER and (not made or -ranges[0][0] >= least()):
                taken.append(heappop(ranges)[2])
            if not taken:
                return  # the bounds of the others are lower still
            node, start, stop = np.stack(taken, axis=1)
            small = (stop - start).sum(axis=1) <= SMALL
            if small.any():
                enter(*self.sums(start[small], stop[small], times))
            node, start, stop = node[~small], start[~small], stop[~small]
            if not len(node):
                continue
            heaviest = np.argmax(np.where(node >= 0, self.impact[node] * times, -1), axis=1)
            at = self.doc[node[np.arange(len(node)), heaviest]]
            before, after, hit = self.split(node, start, stop, at)
            enter(at, (hit * times).sum(axis=1))
            sides = np.stack([np.concatenate(x) for x in zip(before, after)])
            bounds = np.where(sides[0] >= 0, self.impact[sides[0]] * times, 0).sum(axis=1)
            for i in np.flatnonzero(bounds >= least()).tolist():
                made += 1
                heappush(ranges, (-int(bounds[i]), made, sides[:, i]))


class Segments:
    """A task's documents as postings of the queries' terms, searched whenever a segment is full."""

    def __init__(self, weights: dict[bytes, tuple[int, int]], queries: list[tuple[int, list[tuple[int, int]]]], documents: int, length: int, k: int, most: int):
        self.weights, self.queries, self.documents, self.length, self.k, self.most = weights, queries, documents, length, k, most
        self.weight = np.zeros(len(weights), np.int64)
        for number, weight in weights.values():
            self.weight[number] = weight
        self.best: list[list] = [[] for _ in queries]
        self.empty()

    def empty(self) -> None:
        self.ids, self.norms, self.sizes, self.terms, self.counts = [], [], [], [], []

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = split_terms(text)
        if not words:
            return
        known = [(self.weights[t][0], tf) for t, tf in Counter(words).items() if t in self.weights]
        self.ids.append((doc_id is None, doc_id or 0))
        self.norms.append(100 - FLAT + FLAT * len(words) * self.documents // self.length)
        self.sizes.append(len(known))
        self.terms += [t for t, _ in known]
        self.counts += [tf for _, tf in known]
        if len(self.terms) >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.terms:
            place = np.empty(len(self.ids), np.int64)
            order = sorted(range(len(self.ids)), key=self.ids.__getitem__)
            place[order] = np.arange(len(order))
            term, tf = np.array(self.terms, np.int64), np.array(self.counts, np.int64)
            norm = np.repeat(np.array(self.norms, np.int64), self.sizes)
            impact = self.weight[term] * ((FULL * tf) // (GAIN * tf + 8 * norm))
            some = impact > 0
            if some.any():
                treaps = Treaps(term[some], np.repeat(place, self.sizes)[some], impact[some])
                ids = [self.ids[i] for i in order]
                for (_, query), best in zip(self.queries, self.best):
                    treaps.search(query, best, self.k, ids)
        self.empty()


RESULT = "item long, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of items, all if fewer.

    Equal scores come by ascending doc_id, null last; documents that share an id are documents of their own, as are
    items; of equal ones either comes first. Null and empty texts have no terms, so they are never found and find
    nothing. Empty tables give no rows. Further columns are not read.

    Items go to the tasks in blocks of about BLOCK_TERMS terms, a pass over the documents each, so that what a task
    is sent stays bounded. No text is shuffled. A task holds one segment and the k best of a block's items.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    found = terms(whole_text(query_col))
    items = ws.save(items.select(F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("item"), found.alias("terms")))
    wanted = items.select(F.explode("terms").alias("term")).distinct()
    frequencies, documents, length = statistics(docs, wanted, text_col)
    of_item = items.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    of_item = of_item.join(frequencies, "term").select("item", "term", "times", weight.cast("long").alias("weight"))
    blocks = max(1, -(-of_item.count() // BLOCK_TERMS)) if documents else 0
    of_item = ws.save(of_item.withColumn("block", F.pmod(F.hash("item"), F.lit(max(1, blocks))))) if blocks else None

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tops = [_search_block(texts, of_item.filter(F.col("block") == b), documents, length, k) for b in range(blocks)]
    top = spark.createDataFrame([], RESULT)
    for part in tops:
        top = top.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = top.withColumn("rank", rank).filter(F.col("rank") <= k)  # Spark cuts each task's list to k before it shuffles
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(texts: DataFrame, of_item: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    weights: dict[bytes, tuple[int, int]] = {}
    queries: dict[int, list[tuple[int, int]]] = {}
    for row in of_item.select("item", "term", "times", "weight").collect():  # at most about BLOCK_TERMS rows
        number, _ = weights.setdefault(row.term.encode(), (len(weights), row.weight))
        queries.setdefault(row.item, []).append((number, row.times))
    sent = texts.sparkSession.sparkContext.broadcast((weights, sorted(queries.items()), documents, length, k, SEGMENT))
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def best(batches):
        segments = Segments(*sent.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                segments.add(doc_id, text.as_py())
        segments.flush()
        rows = [(item, None if missing else doc, -score) for (item, _), found in zip(segments.queries, segments.best) for score, missing, doc in found]
        columns = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return texts.mapInArrow(best, RESULT)
