"""Table functions for SQL: the parts of a file, used with LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def _parts(walker: str):
    """A table function of (tag, start, data, stop): the segments or chunks of a file, none for a null or foreign content."""

    class Parts:
        def eval(self, content: bytes):
            from traceloom.operators.containers import WALKERS

            if content is not None:
                yield from ((tag, start, data, stop) for tag, start, data, stop in WALKERS[walker](bytes(content)))

    Parts.__name__ = f"{walker.title()}Parts"
    return udtf(Parts, returnType="tag string, start long, data long, stop long")


class Boxes:
    """(path, depth, kind, start, stop, reason): the boxes within a file, wherever they stand."""

    def eval(self, content: bytes):
        from traceloom.operators.boxes import find_boxes, walk_boxes

        data = bytes(content or b"")
        for number, (start, stop) in enumerate(find_boxes(data)):
            yield from walk_boxes(data, start, stop, number)


class SvgTokens:
    """(seq, token): comments, sections, instructions, tags and the texts between them, in order; they join to the text."""

    def eval(self, text: str):
        import regex

        from traceloom.operators.svg import PIECE

        pattern = SvgTokens.patterns.setdefault(PIECE, regex.compile(PIECE.replace(r"\z", r"\Z")))
        yield from enumerate(m.group() for m in pattern.finditer(text or ""))


SvgTokens.patterns = {}

FUNCTIONS = {
    "jpeg_segments": lambda: _parts("jpeg"),
    "png_chunks": lambda: _parts("png"),
    "webp_chunks": lambda: _parts("webp"),
    "jumbf_boxes": lambda: udtf(Boxes, returnType="path string, depth int, kind string, start long, stop long, reason string"),
    "svg_tokens": lambda: udtf(SvgTokens, returnType="seq int, token string"),
}


def register_table_functions(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS known to SQL under their names; each takes a column of the row beside it: FROM files, LATERAL png_chunks(content)."""
    for name, make in FUNCTIONS.items():
        spark.udtf.register(name, make())
    return list(FUNCTIONS)
