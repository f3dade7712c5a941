"""Runs of words that several documents share, wherever lines break: winnowed windows, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, join_groups, whole_text

#: Words of a run at least, and of the windows by which runs are found: of any RUN - WINDOW + 1 successive ones, the least is chosen.
RUN, WINDOW = 50, 26
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: What a byte adds to its word's hash, A to Z as a to z.
_VALUE = np.where(_WORD, np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1), np.uint64(0))
#: Bytes of texts that are hashed at a time.
SLICE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts a to b, their bytes and where each begins in these, and their end: about SLICE bytes at a time, texts whole. None is null."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A to Z lower-cased, and the byte at which it begins."""
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    powers, inverse = _powers(max(len(data), SLICE))
    return _mixed(np.add.reduceat(_VALUE[data] * powers[: len(data)], starts) * inverse[starts]), starts


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words."""
    out, done, part, length = None, 0, words, 1
    size = len(words) - n + 1
    while True:
        if n >> (length.bit_length() - 1) & 1:
            more = part[done : done + size] * _power(done)
            out, done = more if out is None else out + more, done + length
        if done == n:
            return _mixed(out)
        part = part[:-length] + part[length:] * _power(length)
        length *= 2


def chosen(words: np.ndarray) -> np.ndarray:
    """Places of windows, among them one of WINDOW words within each run of RUN words; equal runs have equal ones."""
    if len(words) < RUN:
        return np.empty(0, np.int64)
    among = np.lib.stride_tricks.sliding_window_view(windows(words, WINDOW), RUN - WINDOW + 1)
    return np.unique(among.argmin(1) + np.arange(len(among)))


def _over(best: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """The least or greatest of each n successive values."""
    length = 1
    while length < n:
        step = min(length, n - length)
        x = best(x[:-step], x[step:])
        length += step
    return x


def chosen_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """chosen() of many texts that begin at `bounds`: places among all words, the texts' numbers, and the windows' hashes."""
    none, within = np.empty(0, np.int64), RUN - WINDOW + 1
    if len(words) < RUN:
        return none, none, np.empty(0, np.uint64)
    h, size = windows(words, WINDOW), np.diff(bounds)
    left = np.repeat(bounds[1:], size) - np.arange(len(words))  # words to the text's end
    # the least of each run, or 0 where none begins; a window is chosen if the greatest of these, among the runs that hold it, is its own hash
    least = np.where(left[: len(words) - RUN + 1] >= RUN, _over(np.minimum, h, within), np.uint64(0))
    edge = np.zeros(within - 1, np.uint64)
    places = np.flatnonzero(_over(np.maximum, np.concatenate([edge, least, edge]), within) == h)
    of = np.searchsorted(bounds, places, "right") - 1
    whole = (size[of] >= RUN) & (left[places] >= WINDOW)
    places, of = places[whole], of[whole]
    # of equal windows in a run, chosen() takes the first alone
    order = np.argsort(h[places], kind="stable")
    tied = (np.diff(h[places][order]) == 0) & (np.diff(places[order]) < within)
    if again := np.unique(of[order[1:][tied]]).tolist():
        places = np.sort(np.concatenate([places[~np.isin(of, again)], *(bounds[t] + chosen(words[bounds[t] : bounds[t + 1]]) for t in again)]))
        of = np.searchsorted(bounds, places, "right") - 1
    return places, of, h[places]


def looked_at(n: int, among: np.ndarray, places: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In a text of n words with chosen places `among`: starts of windows of RUN words around shared places, and numbers that rise by one where no end of a run can lie between.

    Places that are shared and follow each other among the chosen ones are a chain, as long as whoever has the one has
    the other too, as far from it (`after` of the one and `before` of the other say so). So a chain has the same
    partners all along, and is a chain in their texts too. All windows that hold its first or last place are looked
    at; between these, only those that start at a place.
    """
    number = np.searchsorted(among, places)
    first = np.concatenate([[True], (np.diff(number) > 1) | ~(after[:-1] & before[1:])])
    ends = np.unique(np.concatenate([places[first], places[np.append(first[1:], True)]]))
    starts = np.unique(np.concatenate([places, (ends[:, None] - np.arange(RUN - WINDOW + 1)).ravel()]))
    starts = starts[(starts >= 0) & (starts <= n - RUN)]
    if not len(starts):
        return starts, starts
    inside = np.zeros(n + 1, np.int64)  # how many chains cover the step to a word
    np.add.at(inside, places[first] + 1, 1)
    np.add.at(inside, places[np.append(first[1:], True)] + 1, -1)
    covered = np.cumsum(inside)[starts[1:]] > 0
    return starts, np.cumsum(np.concatenate([[0], np.where(covered | (np.diff(starts) == 1), 1, 2)]))


def shared_hashes(spots: DataFrame, *more, low: str = "doc_id", high: str = "doc_id") -> DataFrame:
    """The hashes that documents of two ids have, how many times each occurs (n), and further aggregates; low and high are the least and greatest id of a row."""
    return spots.groupBy("h").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count("*").alias("n"), *more).filter("low < high").drop("low", "high")


def shared_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of at least RUN words that documents of different ids share word for word, whatever their lines.

    Any such run holds a chosen window in either document. Around those that are shared, windows of
    RUN words are looked at, and those that are shared again, joined where they follow each other,
    are the runs; so the work grows with the words, not with pairs. Runs with a common window, or a chain of such, are one class. Returns doc_id, paragraph and first_word (of the run's
    start, from 0), n_words, class_id, occurrences, kept (true for the first by doc_id and word).
    Rows of equal id and text count once. Equal texts have equal runs, so one of them is looked at. Null texts have no words; null ids don't make a run shared.
    """
    ws = Workspace(docs.sparkSession)
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))

    def choose(batches):
        for batch in batches:
            owners, found = [np.empty(0, np.int64)], [np.empty((4, 0), np.int64)]
            for a, _, data, bounds in slices(batch.column(2)):
                words, begins = word_hashes(data, bounds)
                bounds = np.searchsorted(begins, bounds)
                places, of, h = chosen_of(words, bounds)
                if not len(places):
                    continue
                # the places before and after, and how far away they are
                far, same = np.diff(places).astype(np.uint64), of[1:] == of[:-1]
                before, after = (np.where(same, _mixed(x + far).view(np.int64), 0) for x in (h[:-1], h[1:]))
                owners.append(a + of)
                found.append(np.stack([places - bounds[of], h.view(np.int64), np.append(0, before), np.append(after, 0)]))
            place, h, before, after = np.concatenate(found, 1)
            of = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(place.astype(np.int32)), pa.array(h), pa.array(before), pa.array(after)], names=["doc_id", "t", "place", "h", "before", "after"])

    first = ws.save(texts.mapInArrow(choose, "doc_id long, t long, place int, h long, before long, after long"))
    shared = ws.save(shared_hashes(first, *[(F.min(c) == F.max(c)).alias(f"same_{c}") for c in ("before", "after")]))
    met = join_groups(first.drop("before", "after"), shared, ["h"], "n").groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("place", "same_before", "same_after"))).alias("places"))
    met = ws.save(met.withColumnsRenamed({"doc_id": "of", "t": "m"}))
    ws.drop(first)
    least_of = F.min(F.struct(F.col("of").isNull(), "of"))["of"].alias("of")
    one = ws.save(met.groupBy("m").agg(least_of, F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("copies"), F.first("places").alias("places")))

    def around(batches):
        names = ["t", "low", "high", "place", "seq", "h", "line"]
        for batch in batches:
            counts, found = [], [np.empty((4, 0), np.int64)]
            for a, b, data, bounds in slices(batch.column(3)):
                words, begins = word_hashes(data, bounds)
                ends, lines = np.flatnonzero(data == 10), bounds
                bounds = np.searchsorted(begins, bounds)
                among, of, _ = chosen_of(words, bounds)
                whole, cuts = windows(words, RUN) if len(words) >= RUN else words, np.searchsorted(of, np.arange(b - a + 1))
                for k in range(b - a):
                    spots, low, high = batch.column(4)[a + k].values, bounds[k], bounds[k + 1]
                    same = (spots.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("same_before", "same_after"))
                    starts, number = looked_at(high - low, among[cuts[k] : cuts[k + 1]] - low, np.asarray(spots.field("place"), np.int64), *same)
                    counts.append(len(starts))
                    line = np.searchsorted(ends, begins[low + starts]) - np.searchsorted(ends, lines[k])
                    found.append(np.stack([starts, number, whole[low + starts].view(np.int64), line]))
            place, seq, h, line = np.concatenate(found, 1)
            of = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            columns = [*(c.take(of) for c in batch.columns[:3]), *(pa.array(x.astype(np.int32)) for x in (place, seq)), pa.array(h), pa.array(line.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    near = texts.join(one, (F.col("t") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("t", "low", "high", "text", "places")
    spots = ws.save(near.mapInArrow(around, "t long, low long, high long, place int, seq int, h long, line int"))
    island = F.col("seq") - F.dense_rank().over(Window.partitionBy("t").orderBy("seq"))
    hits = join_groups(spots.drop("low", "high"), ws.save(shared_hashes(spots, low="low", high="high")), ["h"], "n").withColumn("island", island)
    hits = ws.save(hits.withColumn("least", F.min("h").over(Window.partitionBy("t", "island"))))
    ws.drop(spots)
    apart = hits.groupBy("h").agg(F.min("least").alias("b"), F.max("least").alias("most"), F.count("*").alias("n")).filter("b < most").drop("most")
    links = join_groups(hits, ws.save(apart), ["h"], "n").filter("least <> b").select(F.col("least").alias("a"), "b").distinct()
    classes = ws.save(components(links).select(F.col("node").alias("least"), "component"))
    runs = hits.groupBy("t", "island", "least").agg(F.min("place").cast("long").alias("first_word"), F.min("line").alias("paragraph"), (F.max("place") - F.min("place") + RUN).alias("n_words"))
    runs = ws.save(runs.join(classes, "least", "left").withColumn("class_id", F.coalesce("component", "least")).join(one.select(F.col("m").alias("t"), "copies"), "t"))
    runs = ws.save(join_groups(met.select(F.col("of").alias("doc_id"), F.col("m").alias("t")), runs, ["t"], "copies"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "first_word", "t")
    counts = runs.groupBy("class_id").agg(F.count("*").alias("occurrences"), F.min(rank).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")) & (F.col("first_word") == F.col("first.first_word"))
    return runs.join(counts, "class_id").select("doc_id", "paragraph", "n_words", "class_id", "occurrences", kept.alias("kept"), "first_word")
