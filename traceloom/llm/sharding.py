"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, buckets, join_groups, whole_text

#: Groups of at least this part of all bytes are packed first, together: there can be no more of them than this.
HEAVY = 16384
#: Groups that one task packs at a time.
CELL = 4096


class CapacityTree:
    """Balanced (AVL) tree of (remaining capacity, bin), for the tightest bin that still holds a size."""

    def __init__(self, capacities=()):
        self.root = None
        for number, left in enumerate(capacities):
            self.add(left, number)

    # a node is [key, left, right, height]
    @staticmethod
    def _height(node):
        return node[3] if node else 0

    def _fix(self, node):
        height = self._height
        node[3] = 1 + max(height(node[1]), height(node[2]))
        lean = height(node[1]) - height(node[2])
        if lean > 1:
            if height(node[1][1]) < height(node[1][2]):
                node[1] = self._turn(node[1], 2)
            return self._turn(node, 1)
        if lean < -1:
            if height(node[2][2]) < height(node[2][1]):
                node[2] = self._turn(node[2], 1)
            return self._turn(node, 2)
        return node

    def _turn(self, node, side):
        """Rotate: the child on that side takes the node's place."""
        child, other = node[side], 3 - side
        node[side], child[other] = child[other], node
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        child[3] = 1 + max(self._height(child[1]), self._height(child[2]))
        return child

    def _insert(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._insert(node[side], key)
        return self._fix(node)

    def _delete(self, node, key):
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._delete(node[side], key)
        elif node[1] is None or node[2] is None:
            return node[1] or node[2]
        else:
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = self._delete(node[2], least[0])
        return self._fix(node)

    def add(self, left, number):
        self.root = self._insert(self.root, (left, number))

    def take(self, size):
        """Remove and return the (remaining, bin) that fits most tightly, or None."""
        node, best, want = self.root, None, (size, -1)
        while node:
            if node[0] >= want:
                node, best = node[1], node[0]
            else:
                node = node[2]
        if best:
            self.root = self._delete(self.root, best)
        return best

    def take_emptiest(self):
        node = self.root
        while node[2]:
            node = node[2]
        self.root = self._delete(self.root, node[0])
        return node[0]


def best_fit(sizes, capacities):
    """The bin of each size (given in falling order), -1 where none holds it, and the capacities left."""
    tree, left, placed = CapacityTree(capacities), list(capacities), []
    for size in sizes:
        bin_ = tree.take(size)
        if bin_ is None:
            placed.append(-1)
            continue
        left[bin_[1]] -= size
        tree.add(left[bin_[1]], bin_[1])
        placed.append(bin_[1])
    return placed, left


def _place_all(sizes, left, fixed):
    """As best_fit; what fits nowhere enters the emptiest bin, or with a fixed capacity a bin of its own."""
    tree, left, placed = CapacityTree(left), list(left), []
    for size in sizes:
        bin_ = tree.take(size)
        if bin_ is None and fixed:
            left.append(fixed)
            bin_ = (fixed, len(left) - 1)
        elif bin_ is None:
            bin_ = tree.take_emptiest()
        left[bin_[1]] -= size
        tree.add(left[bin_[1]], bin_[1])
        placed.append(bin_[1])
    return placed, left


def _equal_capacities(total, heavy, shards):
    """Capacities that sum to the total: equal, but for shards that one group overfills alone."""
    own = []
    for size in heavy:
        if len(own) + 1 < shards and size > -(-total // (shards - len(own))):
            own.append(size)
            total -= size
        else:
            break
    rest = shards - len(own)
    return own + [total // rest + (i < total % rest) for i in range(rest)]


def assign_groups(groups: DataFrame, shards: int = 8, capacity: int | None = None) -> DataFrame:
    """groups(group, weight): the same with shard. capacity: a fixed size of shards instead of their number.

    Groups that are large against the whole (at most HEAVY of them) are packed first, on the driver.
    All others are dealt into cells by hash; each cell is packed by its own task into its share of
    what every shard has left, largest first. What fits no shard of its cell, a few groups of each,
    meets in far fewer cells in the next round. The last groups, about CELL with those that waited
    for this, are placed in any case. With a capacity, once a round places less than half of what it
    got, each cell opens shards of its own, and those under half full are dealt anew in later rounds.
    """
    ws = Workspace(groups.sparkSession)
    total, count = groups.agg(F.sum("weight"), F.count("*")).first()
    total = total or 0
    bound = max(1, total // HEAVY)
    heavy = sorted(((r["weight"], r["group"]) for r in groups.filter(F.col("weight") > bound).select("weight", "group").collect()), key=lambda r: (-r[0], bytes(r[1])))
    if capacity:
        left = [capacity] * max(1, -(-total // capacity))
    else:
        left = _equal_capacities(total, [size for size, _ in heavy], shards)
    placed, left = _place_all([size for size, _ in heavy], left, capacity)
    kind = groups.schema["group"].dataType.simpleString()
    schema = f"group {kind}, weight long, shard int"
    spark = groups.sparkSession
    done = [spark.createDataFrame([(g, s, p) for (s, g), p in zip(heavy, placed)], schema)]
    light = groups.filter(F.col("weight") <= bound).select("group", "weight")
    weight, number = light.agg(F.sum("weight"), F.count("*")).first()
    cells, rounds, held_weight = -(-number // CELL), 0, 0
    held = light.limit(0)
    if number > CELL:  # about half a cell of ordinary groups waits, to even out the shards at the end
        chance = F.pmod(F.xxhash64("group", F.lit(-1)), F.lit(-(-number // (CELL // 2))))
        held, light = light.filter(chance == 0), light.filter(chance != 0)
        held_weight = held.agg(F.sum("weight")).first()[0] or 0
        weight, number = light.agg(F.sum("weight"), F.count("*")).first()
    opening = False
    while number > CELL // 2:
        room, whole, parts, came = [max(0, x) for x in left], weight + held_weight, cells, number

        def fill(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
            cell = cell.sort_values(["weight", "group"], ascending=[False, True], kind="stable")
            bins, free = _place_all(cell["weight"].tolist(), [], capacity)
            loose = {b for b, x in enumerate(free) if 2 * x > capacity} if parts > 1 else ()
            return pd.DataFrame({"group": cell["group"], "weight": cell["weight"], "shard": [-1 if b in loose else b for b in bins], "cell": key[0]}).astype({"shard": "int32"})

        def pack(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
            cell = cell.sort_values(["weight", "group"], ascending=[False, True], kind="stable")
            if len(room) >= 8 * parts:  # many shards: each cell has some of its own
                mine = list(range(key[0], len(room), parts))
                caps = [room[j] for j in mine]
            else:
                part = int(cell["weight"].sum())
                mine, caps = list(range(len(room))), [x * part // whole for x in room]
            bins, _ = best_fit(cell["weight"].tolist(), caps)
            return pd.DataFrame({"group": cell["group"], "weight": cell["weight"], "shard": [mine[b] if b >= 0 else -1 for b in bins]}).astype({"shard": "int32"})

        cell = F.pmod(F.xxhash64("group", F.lit(rounds)), F.lit(cells))
        if opening:  # cells open shards of their own, numbered after all others
            packed = ws.save(light.groupBy(cell.alias("cell")).applyInPandas(fill, f"{schema}, cell long"))
            opened = packed.filter("shard >= 0").select("cell", "shard").distinct().orderBy("cell", "shard").collect()
            number_of = spark.createDataFrame([(c, s, len(left) + i) for i, (c, s) in enumerate(opened)], "cell long, shard int, number int")
            left += [capacity] * len(opened)
            packed = ws.save(packed.join(number_of, ["cell", "shard"], "left").select("group", "weight", F.coalesce("number", F.lit(-1)).alias("shard")))
        else:
            packed = ws.save(light.groupBy(cell.alias("cell")).applyInPandas(pack, schema))
        for shard, used in packed.filter("shard >= 0").groupBy("shard").agg(F.sum("weight")).collect():
            left[shard] -= used
        done.append(packed.filter("shard >= 0"))
        light = packed.filter("shard < 0").select("group", "weight")
        weight, number = light.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
        if capacity and not opening and 2 * number > came:  # little fits what there is
            opening, cells = True, 2 * -(-number // CELL)
        cells, rounds = max(1, min(-(-number // CELL), cells // 2)), rounds + 1
    last = sorted(((r["weight"], r["group"]) for r in light.union(held).collect()), key=lambda r: (-r[0], bytes(r[1])))
    placed, _ = _place_all([size for size, _ in last], left, capacity)
    done.append(spark.createDataFrame([(g, s, p) for (s, g), p in zip(last, placed)], schema))
    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    return result


def number_within(frame: DataFrame, by: str, order: list[str], rows: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within each value of `by`, however large: by hash bucket, then by offset.

    frame must be a stored table, as it is read twice.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets(rows)))
    frame = frame.withColumn("_bucket", bucket)
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = frame.groupBy(by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order))
    return frame.join(offsets.drop("_n"), [by, "_bucket"]).withColumn(name, F.col("_before") + place - 1).drop("_bucket", "_before")


def shard_documents(docs: DataFrame, shards: int = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into shards of nearly equal bytes; equal texts share a shard.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot, grown_shard (null).
    With a capacity, as few shards of at most that size as best fit needs. Null and empty texts have
    size 1, CRC 0, and form one group. Repeated rows are kept, with slots of their own; a null
    doc_id is a value like any other. An empty table gives no rows. A group larger than an equal
    part fills a shard alone, and the others share the rest.
    """
    ws = Workspace(docs.sparkSession)
    text = whole_text(text_col)
    rows = ws.save(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")))
    groups = ws.save(rows.groupBy("group").agg(F.sum("size").alias("weight"), F.count("*").alias("n")))
    shard = assign_groups(groups.select("group", "weight"), shards, capacity).select("group", "shard")
    shard = ws.save(groups.select("group", "n").join(shard, "group"))
    dealt = ws.save(join_groups(rows, shard, ["group"], "n").select("doc_id", "size", "text_crc32", "shard"))
    numbered = number_within(dealt, "shard", ["doc_id", "text_crc32", "size"], dealt.count(), "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
