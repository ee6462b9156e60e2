"""Regular expressions of terminals as lazily built automata with longest-match semantics.

Backtracking engines take the leftmost alternative; a tokenizer needs the longest match of every terminal. So terminals
become one nondeterministic automaton, whose deterministic states are made as texts need them and kept.
"""

from __future__ import annotations

import re

Ranges = tuple[tuple[int, int], ...]
ANY: Ranges = ((0, 0x10FFFF),)
DIGIT: Ranges = ((48, 57),)
WORD: Ranges = ((48, 57), (65, 90), (95, 95), (97, 122))
SPACE: Ranges = ((9, 13), (32, 32), (0xA0, 0xA0), (0xFEFF, 0xFEFF))
_CONTROL = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "0": 0}


class RegexError(ValueError):
    """A pattern that can't be read; the message names the place."""


def negated(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in sorted(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    return (*out, (at, 0x10FFFF)) if at <= 0x10FFFF else tuple(out)


def parse(pattern: str):
    """A tree of ('set', ranges), ('cat', parts), ('alt', parts), ('rep', part, least, most or None)."""
    at = 0

    def fail(what: str):
        raise RegexError(f"{what} at {at} in {pattern!r}")

    def more() -> bool:
        return at < len(pattern)

    def escape() -> Ranges:
        nonlocal at
        if not more():
            fail("trailing backslash")
        c = pattern[at]
        at += 1
        if c in "dDwWsS":
            ranges = {"d": DIGIT, "w": WORD, "s": SPACE}[c.lower()]
            return negated(ranges) if c.isupper() else ranges
        if c in _CONTROL:
            return ((_CONTROL[c],) * 2,)
        if m := re.compile(r"u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})").match(pattern, at - 1):
            at = m.end()
            return ((int(m[1] or m[2] or m[3], 16),) * 2,)
        return ((ord(c),) * 2,)

    def bracket() -> Ranges:
        nonlocal at
        invert = pattern.startswith("^", at)
        at += invert
        out: list[tuple[int, int]] = []
        while True:
            if not more():
                fail("open class")
            c = pattern[at]
            at += 1
            if c == "]":
                break
            one = escape() if c == "\\" else ((ord(c),) * 2,)
            if len(one) == 1 and one[0][0] == one[0][1] and pattern.startswith("-", at) and at + 1 < len(pattern) and pattern[at + 1] != "]":
                at += 1
                c = pattern[at]
                at += 1
                end = escape() if c == "\\" else ((ord(c),) * 2,)
                if end[0][0] < one[0][0]:
                    fail("reversed range")
                one = ((one[0][0], end[0][0]),)
            out += one
        return negated(tuple(out)) if invert else tuple(out)

    def atom():
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            if pattern.startswith("?", at):
                if not pattern.startswith("?:", at):
                    fail("unsupported group")
                at += 2
            inner = alternatives()
            if not pattern.startswith(")", at):
                fail("open group")
            at += 1
            return inner
        if c == "[":
            return ("set", bracket())
        if c == "\\":
            return ("set", escape())
        if c == ".":
            return ("set", negated(((10, 10),)))
        if c in "*+?)":
            fail("nothing to repeat")
        return ("set", ((ord(c),) * 2,))

    def sequence():
        nonlocal at
        parts = []
        while more() and pattern[at] not in "|)":
            part = atom()
            while more():
                if m := re.compile(r"\{(\d+)(,(\d*))?\}").match(pattern, at):
                    least = int(m[1])
                    most = least if m[2] is None else int(m[3]) if m[3] else None
                    at = m.end()
                elif pattern[at] in "*+?":
                    least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[pattern[at]]
                    at += 1
                else:
                    break
                part = ("rep", part, least, most)
            parts.append(part)
        return ("cat", parts)

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while pattern.startswith("|", at):
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    tree = alternatives()
    if more():
        fail("unmatched )")
    return tree


def literal(text: str):
    return ("cat", [("set", ((ord(c),) * 2,)) for c in text])


class Automaton:
    """The terminals' automaton; ``longest`` answers for any permitted subset of them."""

    def __init__(self, trees: list):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[Ranges, int]]] = []
        self.accepts: dict[int, int] = {}
        self.first: list[int] = []
        for k, tree in enumerate(trees):
            start, end = self._state(), self._state()
            self._build(tree, start, end)
            self.first.append(start)
            self.accepts[end] = k
        #: One past the last character that ``shortest`` or ``each`` has looked at; the end counts as a character.
        self.reach = 0
        self._made: dict[frozenset[int], list] = {}
        self._starts: dict[frozenset[int], list] = {}

    def _state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def _build(self, tree, a: int, b: int) -> None:
        kind = tree[0]
        if kind == "set":
            self.moves[a].append((tree[1], b))
        elif kind == "cat":
            for part in tree[1]:
                c = self._state()
                self._build(part, a, c)
                a = c
            self.empty[a].append(b)
        elif kind == "alt":
            for part in tree[1]:
                self._build(part, a, b)
        else:
            _, part, least, most = tree
            for _ in range(least):
                c = self._state()
                self._build(part, a, c)
                a = c
            if most is None:
                c = self._state()
                self.empty[a].append(c)
                self._build(part, c, c)
                self.empty[c].append(b)
            else:
                self.empty[a].append(b)
                for _ in range(most - least):
                    c = self._state()
                    self._build(part, a, c)
                    self.empty[c].append(b)
                    a = c

    def _closed(self, states) -> list:
        """[moves by character so far, accepted terminals, members, the best terminal once asked for] of the deterministic state."""
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        key = frozenset(seen)
        if key not in self._made:
            self._made[key] = [{}, tuple(sorted(self.accepts[s] for s in key if s in self.accepts)), key, None]
        return self._made[key]

    def _move(self, state: list, c: str):
        code = ord(c)
        to = {t for s in state[2] for ranges, t in self.moves[s] if any(lo <= code <= hi for lo, hi in ranges)}
        state[0][c] = out = self._closed(to) if to else None
        return out

    def longest(self, text: str, at: int, permitted: frozenset[int]) -> tuple[int, tuple[int, ...]]:
        """(end, terminals) of the longest match of any permitted terminal; (at, ()) if none consumes anything."""
        state = self._starts.get(permitted)
        if state is None:
            state = self._starts[permitted] = self._closed([self.first[k] for k in permitted])
        end, found = at, ()
        for k in range(at, len(text)):
            c = text[k]
            moves = state[0]
            state = moves[c] if c in moves else self._move(state, c)
            if state is None:
                break
            if state[1]:
                end, found = k + 1, state[1]
        return end, found

    def shortest(self, text: str, at: int, permitted: frozenset[int]) -> tuple[int, tuple[int, ...]]:
        """(end, terminals) of the shortest match; (at, ()) if nothing matches."""
        state = self._closed([self.first[k] for k in permitted])
        for k in range(at, len(text)):
            c = text[k]
            state = state[0][c] if c in state[0] else self._move(state, c)
            if state is None:
                break
            if state[1]:
                self.reach = max(self.reach, k + 1)
                return k + 1, state[1]
        self.reach = max(self.reach, k + 1 if state is None else len(text) + 1)
        return at, ()

    def start(self, permitted: frozenset[int]) -> list:
        state = self._starts.get(permitted)
        if state is None:
            state = self._starts[permitted] = self._closed([self.first[k] for k in permitted])
        return state

    def best(self, text: str, at: int, state: list, rank) -> tuple[int, int] | None:
        """(terminal, end) of the longest match from a start, among those that end there the one of the highest rank."""
        found, k, n = None, at, len(text)
        while k < n:
            c = text[k]
            k += 1
            moves = state[0]
            state = moves[c] if c in moves else self._move(state, c)
            if state is None:
                break
            if state[1]:
                found, end = state, k
        seen = k if state is None else n + 1
        if seen > self.reach:
            self.reach = seen
        if found is None:
            return None
        if found[3] is None:
            found[3] = max(found[1], key=rank)
        return found[3], end

    def each(self, text: str, at: int, permitted: frozenset[int]) -> dict[int, int]:
        """The longest end of each permitted terminal that matches something."""
        state = self._starts.get(permitted)
        if state is None:
            state = self._starts[permitted] = self._closed([self.first[k] for k in permitted])
        out: dict[int, int] = {}
        for k in range(at, len(text)):
            c = text[k]
            state = state[0][c] if c in state[0] else self._move(state, c)
            if state is None:
                break
            for t in state[1]:
                out[t] = k + 1
        self.reach = max(self.reach, k + 1 if state is None else len(text) + 1)
        return out
