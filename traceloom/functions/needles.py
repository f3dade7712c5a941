"""Many needles looked for in a text: one after another in short values, in one pass in long ones."""

from __future__ import annotations

import functools

import ahocorasick
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import by_row


@functools.lru_cache(maxsize=8)
def _automaton(needles: tuple[str, ...]):
    """All needles as one automaton, which reads a text once whatever their number; built once a worker."""
    automaton = ahocorasick.Automaton()
    for needle in needles:
        automaton.add_word(needle, needle)
    automaton.make_automaton()
    return automaton


class Needles:
    """Needles (in lower case, not empty) by priority, with the name that each stands for; of a needle given twice the first counts."""

    def __init__(self, needles: list[tuple[str, str]]):
        self.names = list(dict.fromkeys(name for _, name in needles))
        self.place: dict[str, int] = {}
        for needle, name in needles:
            self.place.setdefault(needle, self.names.index(name))

    def hits(self, text: Column) -> Column:
        """The distinct needles that a text holds, overlapping or not, sorted; null for a null text."""
        needles = tuple(self.place)

        @by_row(T.ArrayType(T.StringType()))
        def found(text):
            return None if text is None else sorted({needle for _, needle in _automaton(needles).iter(text)})

        return found(F.lower(text))

    def first_of(self, hits: Column) -> Column:
        """The name of highest priority among the needles of `hits`; null if there are none."""
        places = F.create_map(*[F.lit(x) for pair in self.place.items() for x in pair])
        return F.get(F.array(*map(F.lit, self.names)), F.array_min(F.transform(hits, lambda h: F.element_at(places, h))))

    def first_name(self, text: Column) -> Column:
        """The same of a short value, as an expression that may stand within others."""

        def first(lower):
            out = F.lit(None).cast("string")
            for needle, place in sorted(self.place.items(), key=lambda x: -x[1]):
                out = F.when(F.contains(lower, F.lit(needle)), self.names[place]).otherwise(out)
            return out

        return F.transform(F.array(F.lower(text)), first)[0]  # lower is bound, so that it is found once
