"""Regular expressions of scan rules as one deterministic automaton over bytes."""

from __future__ import annotations

from itertools import count

import numpy as np


class Nfa:
    """Thompson's construction from the few forms that rules use.

    Literals, \\xHH and escaped characters, classes, groups with alternatives, (?i:...) for ASCII
    letters of either case, and the repetitions ? * + {n} {n,}.
    """

    def __init__(self):
        self.empty, self.bytes, self.number = {}, {}, count()

    def state(self):
        s = next(self.number)
        self.empty[s], self.bytes[s] = [], []
        return s

    def add(self, pattern: str):
        """Start and end of the pattern's part of the automaton."""
        self.text, self.at, self.fold = pattern, 0, False
        ends = self._alternatives()
        assert self.at == len(pattern), f"{pattern} at {self.at}"
        return ends

    def _peek(self):
        return self.text[self.at] if self.at < len(self.text) else ""

    def _alternatives(self):
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.empty[start].append(a)
            self.empty[b].append(end)
            if self._peek() != "|":
                return start, end
            self.at += 1

    def _sequence(self):
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self._atom()
            low, high = self._repetition()
            stop = self.at
            for k in range(max(low, 1)):
                if k:  # the atom once more
                    self.at = begin
                    a, b = self._atom()
                    self.at = stop
                self.empty[end].append(a)
                if low == 0:
                    self.empty[end].append(b)
                end = b
            if high is None:
                self.empty[b].append(a)
        return start, end

    def _repetition(self):
        """Least number, and None where there is no largest; ? is (0, 1)."""
        c = self._peek()
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            low, comma, _ = self.text[self.at + 1 : (stop := self.text.index("}", self.at))].partition(",")
            self.at = stop + 1
            return int(low), None if comma else int(low)
        return 1, 1

    def _atom(self):
        c = self._peek()
        self.at += 1
        if c == "(":
            fold = self.fold
            if self.text.startswith("?i:", self.at):
                self.fold, self.at = True, self.at + 3
            ends = self._alternatives()
            self.at, self.fold = self.at + 1, fold
            return ends
        if c == "[":
            chosen, invert = set(), self._peek() == "^"
            self.at += invert
            while self._peek() != "]":
                low = self._byte()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    chosen |= set(range(low, self._byte() + 1))
                else:
                    chosen.add(low)
            self.at += 1
            chosen = set(range(256)) - chosen if invert else chosen
        else:
            self.at -= 1
            chosen = {self._byte()}
        if self.fold:
            chosen |= {ord(chr(b).swapcase()) for b in chosen if chr(b).isascii() and chr(b).isalpha()}
        start, end = self.state(), self.state()
        self.bytes[start].append((frozenset(chosen), end))
        return start, end

    def _byte(self):
        c = self._peek()
        self.at += 1
        if c == "\\":
            c = self._peek()
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def reversed(self):
        """The same states with all arrows turned round."""
        other = Nfa()
        other.empty, other.bytes = {s: [] for s in self.empty}, {s: [] for s in self.empty}
        for s, to in self.empty.items():
            for t in to:
                other.empty[t].append(s)
        for s, arrows in self.bytes.items():
            for chosen, t in arrows:
                other.bytes[t].append((chosen, s))
        return other


def subset_construction(nfa: Nfa, starts: list[int], accepts: dict[int, int], anywhere: bool):
    """Transitions by class of bytes, accepted rules as bits, and the class of each byte.

    anywhere: a match may start at any byte. Bytes that no arrow tells apart are one class.
    """
    sets = {chosen for arrows in nfa.bytes.values() for chosen, _ in arrows}
    classes: dict[frozenset, int] = {}
    of_byte = [classes.setdefault(frozenset(c for c in sets if b in c), len(classes)) for b in range(256)]
    moves = {s: [(k, t) for chosen, t in arrows for k in {of_byte[b] for b in chosen}] for s, arrows in nfa.bytes.items()}

    def closure(states):
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    reach = {t: closure([t]) for t in nfa.empty}
    again = closure(starts) if anywhere else set()
    useful = {s for s in nfa.bytes if nfa.bytes[s]} | set(accepts)
    first = frozenset(closure(starts) & useful)
    number, rows, todo = {first: 0}, [], [first]
    for now in todo:
        to = [set(again) for _ in classes]
        for s in now:
            for k, t in moves[s]:
                to[k] |= reach[t]
        row = []
        for states in to:
            states = frozenset(states & useful)
            if states not in number:
                number[states] = len(number)
                todo.append(states)
            row.append(number[states])
        rows.append(row)
    bits = [sum({accepts[s] for s in states if s in accepts}) for states in number]
    return rows, bits, of_byte


def minimise(rows, bits, of_byte):
    """Moore's refinement: states that no input tells apart become one. State 0 stays the start."""
    rows = np.array(rows)
    of, parts = np.unique(bits, return_inverse=True)[1], 0
    while of.max() + 1 > parts:
        parts = of.max() + 1
        of = np.unique(np.column_stack([of, of[rows]]), axis=0, return_inverse=True)[1]
    one = np.unique(of, return_index=True)[1]  # the first state of each part
    order = np.argsort(one)
    number = np.argsort(order)[of]
    first = one[order]
    return number[rows[first]].tolist(), [bits[s] for s in first], of_byte


def linked(rows, bits, of_byte):
    """Each state a list: the next state for each byte, then the rules that accept, then whether nothing can follow."""
    states = [[None] * 258 for _ in rows]
    for n, (state, row) in enumerate(zip(states, rows)):
        state[:256] = [states[row[k]] for k in of_byte]
        state[256] = bits[n]
        state[257] = not bits[n] and all(t == n for t in row)
    return states[0]


def compile_rules(patterns: list[str]):
    """The combined automaton of all patterns, matching anywhere, as arrays; rule k is bit 1 << k."""
    nfa, starts, accepts = Nfa(), [], {}
    for k, pattern in enumerate(patterns):
        start, end = nfa.add(pattern)
        starts.append(start)
        accepts[end] = 1 << k
    return minimise(*subset_construction(nfa, starts, accepts, True))


def compile_one(pattern: str, backwards: bool = False):
    """The automaton of one pattern from its start on, or backwards from its end."""
    nfa = Nfa()
    start, end = nfa.add(pattern)
    if backwards:
        nfa, start, end = nfa.reversed(), end, start
    return minimise(*subset_construction(nfa, [start], {end: 1}, False))
