"""Nested boxes, each with its length before it: found in any bytes, and walked as a tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kind of box that holds boxes, the kind its first one must have, bytes of a header, and starts looked at in a file.
PARENT, FIRST, HEADER, STARTS = b"jumb", b"jumd", 8, 4096
TREE = "path string, depth int, kind string, start long, stop long, reason string"


def find_boxes(data: bytes) -> list[tuple[int, int]]:
    """(start, stop) of the outermost parent boxes: a length that fits into the file, the kind, and a first child of the right kind."""
    found, at, inside = [], -1, 0
    for _ in range(STARTS):
        at = data.find(PARENT, at + 1)
        if at < 0:
            break
        start = at - 4
        length = int.from_bytes(data[max(start, 0) : at], "big")
        if start >= inside and length >= 2 * HEADER and start + length <= len(data) and data[at + HEADER : at + HEADER + 4] == FIRST:
            found.append((start, start + length))
            inside = start + length
    return found


def walk_boxes(data: bytes, start: int, stop: int, number: int = 0) -> list[tuple]:
    """(path, depth, kind, start, stop, reason) of every box from `start` to `stop`, parents before children.

    A stack holds the ends of the open boxes. Length 0 reaches to the end of the box around, length 1 has 8 more
    bytes of length. A box that is longer than the one around it ("longer than its parent") is cut off there, one
    shorter than its header ("shorter than its header") and fewer than 8 bytes ("no room for a header") end the box around.
    """
    rows, open_ = [], [[stop, "", number]]
    at = start
    while open_:
        end, path, count = open_[-1]
        if at >= end:
            open_.pop()
            continue
        here, depth = f"{path}/{count}" if path else str(count), len(open_) - 1
        open_[-1][2] += 1
        if end - at < HEADER:
            rows.append((here, depth, None, at, end, "no room for a header"))
            at = end
            continue
        length, kind, header = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], HEADER
        if length == 1 and end - at >= 16:
            length, header = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif length == 0:
            length = end - at
        name = kind.decode("latin-1")
        if length < header:
            rows.append((here, depth, name, at, end, "shorter than its header"))
            at = end
        elif length > end - at:
            rows.append((here, depth, name, at, end, "longer than its parent"))
            at = end
        else:
            rows.append((here, depth, name, at, at + length, None))
            if kind == PARENT:
                open_.append([at + length, here, 0])
                at += header
            else:
                at += length
    return rows


def box_trees(files: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """item_id, path, depth, kind, start, stop, reason: every box within each parent box that stands in a file, wherever it stands.

    path numbers the boxes from 0, level by level; start and stop are places in the file. Rows of one id are files of
    their own, whose boxes come together; a null content and one without a box have no row. A file is walked within
    its task, and nothing is shuffled: memory is a file and its boxes.
    """
    rows = files.select(F.col(id_col).alias("item_id"), F.col(content_col).alias("content"))
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [part.split(" ")[0] for part in TREE.split(", ")]

    def walk(batches):
        for batch in batches:
            of, out = [], []
            for i, content in enumerate(batch.column(1)):
                data = content.as_py() or b""
                for number, (start, stop) in enumerate(find_boxes(data)):
                    boxes = walk_boxes(data, start, stop, number)
                    of += [i] * len(boxes)
                    out += boxes
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["item_id", *names])

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(walk, f"item_id {kind}, {TREE}")
