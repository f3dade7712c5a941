"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BATCH, Workspace, whole_text

#: Pieces that one population packs; islands of such a cell; its epochs, with migration between them.
CELL, ISLANDS, EPOCHS = 1024, 2, 2
#: Individuals of an island, and generations of an epoch. A cell at its lower bound takes none.
POPULATION, GENERATIONS = 6, 4
#: Displaced pieces that are tried in the place of placed ones at a time, and rounds of this.
DISPLACED, ROUNDS = 96, 6
#: Sequences filled to less than this are opened again and packed with those of other cells.
WELL_FILLED = 0.97
#: Words whose ids a worker keeps.
MEMO = 200_000


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Ids, as little-endian 32-bit bytes, of a space and the run of text up to the next space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run):
        if len(self) >= MEMO:
            self.clear()
        ids = self[run] = self.encode(" " + run)
        return ids


@functools.lru_cache(maxsize=4)
def token_bytes(vocabulary: str):
    """A function from a text to the bytes of its ids.

    The tokenizer cuts a text before every space that stands between two other characters, so runs
    between single spaces are encoded one by one and kept; any other text is encoded whole.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    special = [str(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    irregular = re.compile("|".join([r"\s\s", *map(re.escape, special)]))

    def plain(text):
        return b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)

    encode = plain
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    if vocabulary.endswith(".json") and os.path.exists(ranks):  # the same vocabulary, in a faster library
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text):
            return b"".join(i.to_bytes(4, "little") for i in fast.encode_ordinary(text))

    memo = Memo(encode)

    def ids(text):
        if irregular.search(text):
            return plain(text)
        first, *runs = text.split(" ")
        return encode(first) + b"".join(map(memo.__getitem__, runs))

    return ids


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and a closing 0, cut from the end into pieces of `capacity`."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        ids = token_bytes(vocabulary)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(ids(text.as_py()) + bytes(4))
                n = len(data) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    out.append((doc, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_into(sizes, items, bins, fills, capacity):
    """Put items (indices into sizes), largest first, into the fullest bin that holds each; bins and fills grow."""
    free = sorted((capacity - fill, b) for b, fill in enumerate(fills))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at == len(free):
            b = len(bins)
            bins.append([])
            fills.append(0)
            left = capacity
        else:
            left, b = free.pop(at)
        bins[b].append(i)
        fills[b] += size
        if left > size:
            insort(free, (left - size, b))
    return bins, fills


def least_bins(sizes, capacity):
    """A lower bound of the bins: the sum over the capacity, or more where pieces over half of it need bins of their own."""
    half = sorted((s for s in sizes if 2 * s > capacity), reverse=True)
    small = sorted((s for s in sizes if 2 * s <= capacity), reverse=True)
    best, total, k, own = max(len(half), -(-sum(sizes) // capacity)), 0, len(half), 0
    for least in small:  # pieces below `least` are left out, and so is room that only they could fill
        total += least
        while k and half[k - 1] <= capacity - least:
            k -= 1
            own += half[k]
        room = (len(half) - k) * capacity - own
        best = max(best, len(half) + max(0, -(-(total - room) // capacity)))
    return best


def fitness(fills, capacity):
    """Falkenauer's: the mean of squared fills; few, full bins score high."""
    return sum((f / capacity) ** 2 for f in fills) / max(1, len(fills))


def _with_pairs(numbers, sizes, first, second):
    """Arrays (sum, first, second) of single pieces (second is -1) and of pairs of them, given by their places among the numbers."""
    one, two = numbers[first], numbers[second]
    sums = np.concatenate([sizes[numbers], sizes[one] + sizes[two]])
    return sums, np.concatenate([numbers, one]), np.concatenate([np.full(len(numbers), -1), two])


def exchange(sizes, loose, bins, fills, capacity, rng):
    """Put one or two loose pieces in the place of one or two placed ones wherever that fills a bin more; what they displace is loose instead.

    Dominance: a fuller bin with fewer, larger pieces leaves the smaller ones, which are easier to place.
    """
    sizes, mix = np.asarray(sizes, np.int64), np.random.default_rng(rng.getrandbits(32))
    for _ in range(ROUNDS):
        free = capacity - np.array(fills, np.int64)
        if not loose or not (free > 0).any():
            break
        some = np.array(loose if len(loose) <= DISPLACED else rng.sample(loose, DISPLACED), np.int64)
        total, new_one, new_two = _with_pairs(some, sizes, *np.triu_indices(len(some), 1))
        order = np.argsort(total, kind="stable")
        total, new_one, new_two = total[order], new_one[order], new_two[order]
        owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        placed = np.concatenate([np.array(b, np.int64) for b in bins])
        shuffled = np.lexsort((mix.random(len(owner)), owner))  # each piece is paired with the next one of its shuffled bin
        placed = placed[shuffled][free[owner] > 0]
        owner = owner[free[owner] > 0]
        next_ = np.flatnonzero(owner[1:] == owner[:-1])
        out, old_one, old_two = _with_pairs(placed, sizes, next_, next_ + 1)
        owner = np.concatenate([owner, owner[next_]])
        best = np.searchsorted(total, out + free[owner], "right") - 1
        gain = np.where(best >= 0, total[best] - out, 0)
        used, changed = set(), set()
        for k in np.argsort(-gain, kind="stable")[: np.count_nonzero(gain > 0)].tolist():
            b, new = int(owner[k]), [int(x) for x in (new_one[best[k]], new_two[best[k]]) if x >= 0]
            if b in changed or not used.isdisjoint(new):
                continue
            old = [int(x) for x in (old_one[k], old_two[k]) if x >= 0]
            bins[b] = [i for i in bins[b] if i not in old] + new
            fills[b] += int(gain[k])
            used.update(new)
            changed.add(b)
            loose = loose + old
        if not changed:
            break
        loose = [i for i in loose if i not in used]
    return loose


def crossover(one, two, sizes, capacity, rng):
    """Inject well-filled bins of two into one; bins of one that share a piece with them go, and what they alone held is placed anew."""
    fills = [sum(sizes[i] for i in b) for b in two]
    best = sorted(range(len(two)), key=lambda b: -fills[b])[: max(1, len(two) // 2)]
    chosen = [two[b] for b in best if rng.random() < 0.5]
    taken = {i for b in chosen for i in b}
    bins, loose = [list(b) for b in chosen], []
    for b in one:
        if taken.isdisjoint(b):
            bins.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    fills = [sum(sizes[i] for i in b) for b in bins]
    worst = sorted(range(len(bins)), key=lambda b: fills[b])[: 1 + len(bins) // 50]  # mutation: the emptiest bins are opened too
    for b in sorted(worst, reverse=True):
        loose += bins.pop(b)
        fills.pop(b)
    loose = exchange(sizes, loose, bins, fills, capacity, rng)
    return best_fit_into(sizes, loose, bins, fills, capacity)[0]


def shared_part(one, two):
    """The part of the bins of one that two has as well."""
    have = {tuple(sorted(b)) for b in two}
    return sum(tuple(sorted(b)) in have for b in one) / max(1, len(one))


def evolve(sizes, population, capacity, generations, size, seed):
    """Run an island for some generations; returns its population, best first.

    The first individual is plain best fit decreasing. If it has as many bins as the sizes need at
    least, it is the whole population: nothing can be gained.
    """
    rng = Random(seed)
    score = lambda bins: fitness([sum(sizes[i] for i in b) for b in bins], capacity)
    least = least_bins(sizes, capacity)
    while len(population) < size and not (population and len(population[0]) <= least):
        noisy = [s * (1 + 0.1 * rng.random() * bool(population or seed % 2)) for s in sizes]
        order = sorted(range(len(sizes)), key=lambda i: -noisy[i])
        bins, fills = [], []
        for run in (order[k : k + 64] for k in range(0, len(order), 64)) if population or seed % 2 else [order]:
            best_fit_into(sizes, run, bins, fills, capacity)
        population.append(bins)
    ranked = sorted(((score(b), b) for b in population), key=lambda x: -x[0])
    for _ in range(generations):
        if len(ranked[0][1]) <= least:
            break
        for _ in range(2):
            some = rng.sample(range(len(ranked)), min(4, len(ranked)))
            one = min(some)
            others = [k for k in some if k != one] or [one]
            two = min(others, key=lambda k: shared_part(ranked[one][1], ranked[k][1]))  # the least alike of three
            child = crossover(ranked[one][1], ranked[two][1], sizes, capacity, rng)
            ranked.append((score(child), child))
        ranked = sorted(ranked, key=lambda x: -x[0])[:size]
    return [b for _, b in ranked]


def _flat(bins, n):
    """Bins as the number of the bin of each piece."""
    of = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            of[i] = b
    return of


def _bins(of):
    bins = [[] for _ in range(max(of, default=-1) + 1)]
    for i, b in enumerate(of):
        bins[b].append(i)
    return [b for b in bins if b]


ISLAND = "cell long, island int, uids array<long>, sizes array<long>, population array<array<int>>"


def _epoch(islands: DataFrame, capacity: int, epoch: int, generations: int, size: int) -> DataFrame:
    """islands (ISLAND, and a guest array<int> from another island or null), after some generations."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                sizes = [int(x) for x in row.sizes]
                population = [_bins([int(b) for b in of]) for of in (row.population if row.population is not None else [])]
                if row.guest is not None and population:
                    population[-1] = _bins([int(b) for b in row.guest])
                seed = (row.cell * 31 + row.island) * 31 + epoch * 2 + (row.island > 0)
                out.append([_flat(b, len(sizes)) for b in evolve(sizes, population, capacity, generations, size, int(seed) * 2 + (row.island > 0))])
            yield pdf[["cell", "island", "uids", "sizes"]].assign(population=out)

    return islands.select("cell", "island", "uids", "sizes", "population", "guest").mapInPandas(run, ISLAND)


def pack_items(items: DataFrame, capacity: int, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """items(uid, length), uid unique and length at most capacity: uid, sequence_id and offset.

    Pieces that fill a sequence alone get one. The others are dealt into cells by hash. Each cell has
    islands, one row each, that evolve as tasks of their own; between epochs the best packing of an
    island goes to the next island of its cell. Sequences of the best island that stay loose are
    opened and packed again with those of other cells, in ever fewer cells, until one cell remains
    or too few are loose to gain from it.
    """
    ws = Workspace(items.sparkSession)
    full = items.filter(F.col("length") == capacity).select("uid", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose, number, turn, done = items.filter(F.col("length") < capacity).select("uid", "length"), None, 0, [full]
    number = loose.count()
    while number:
        cells = -(-number // cell)
        dealt = loose.groupBy(F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(cells)).cast("long").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("length", "uid")), False).alias("p"))
        first = F.lit(None).cast("array<array<int>>")
        state = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("p.uid").alias("uids"), F.col("p.length").alias("sizes"), first.alias("population"), F.lit(None).cast("array<int>").alias("guest"))
        state = state.repartition("cell", "island")
        for epoch in range(epochs):
            evolved = ws.save(_epoch(state, capacity, epoch, generations, population), BATCH)
            best = evolved.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("population")[0].alias("guest"))
            state = evolved.join(best, ["cell", "island"])
        count = F.array_max(F.col("population")[0])
        winner = evolved.groupBy("cell").agg(F.min_by(F.struct("uids", "sizes", F.col("population")[0].alias("of")), F.struct(count, "island")).alias("w"))
        placed = winner.select("cell", F.explode(F.arrays_zip("w.uids", "w.sizes", "w.of")).alias("x")).select("cell", F.col("x.uids").alias("uid"), F.col("x.sizes").alias("length"), F.col("x.of").alias("bin"))
        bins = placed.groupBy("cell", "bin").agg(F.sort_array(F.collect_list(F.struct("length", "uid")), False).alias("p"), F.sum("length").alias("fill"))
        bins = ws.save(bins.withColumn("keep", F.lit(cells == 1) | (F.col("fill") >= WELL_FILLED * capacity)))
        sequence = ((F.lit(turn).cast("long") * (1 << 50) + F.col("cell") * (1 << 20) + F.col("bin")) * 2 + 1).alias("sequence_id")
        before = F.transform("p", lambda _, i: F.aggregate(F.slice("p", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["length"]))
        open_ = bins.filter("not keep").agg(F.coalesce(F.sum(F.size("p")), F.lit(0))).first()[0]
        last = cells > 1 and open_ > 0.8 * number
        kept = bins if last else bins.filter("keep")
        done.append(kept.select(sequence, F.explode(F.arrays_zip(F.col("p.uid").alias("uid"), before.alias("offset"))).alias("x")).select("x.uid", "sequence_id", "x.offset"))
        if last:
            break
        loose = bins.filter("not keep").select(F.explode("p").alias("x")).select("x.uid", "x.length")
        number, turn = open_, turn + 1
    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    return result


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack tokenized documents into as few sequences of `capacity` tokens as it can.

    A document is its ids, then id 0; null and empty texts are id 0 alone. Only documents longer than
    capacity are cut, from the end, so that the first piece may be shorter. Returns doc_id, piece,
    start, length, ids_crc32, sequence_id, offset: the pieces of a sequence lie gapless from 0.
    Repeated rows are separate documents; a null doc_id stays null. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    pieces = tokenize_pieces(docs, vocabulary or public_vocabulary(), capacity, id_col, text_col)
    pieces = ws.save(pieces.withColumn("uid", F.monotonically_increasing_id()), BATCH)
    placed = pack_items(pieces.select("uid", "length"), capacity)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
