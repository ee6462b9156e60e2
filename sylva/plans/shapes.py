"""Trees of many texts at once: what follows from a text's tokens alone is made once for each sequence of tokens.

Two texts that read as the same tokens have the same tree but for its places, which are ends of tokens. So the sequences met so
far are kept as a trie, each node with the start of its lexer; a batch of texts walks it in step, a character of every text at
a time. A text that leaves the trie is parsed by itself, and its sequence is added where the parse was clean. Grammars with a
scanner book always parse text by text, as a book reads more than tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .parser import Parser, Tree, flat

#: Bounds of what is kept in a process: cells of the trie and of the lexer, rows of trees, tokens of a text. Beyond them texts parse by themselves.
MOST_CELLS, MOST_ROWS, MOST_TOKENS = 4_000_000, 100_000, 4096
#: Characters that walk at once, and the number of texts below which those left parse by themselves.
MOST_CHARACTERS, FEWEST = 2_000_000, 8
_TERMINALS = 1 << 16


class Shape:
    """A tree without its places: ``start`` and ``end`` of a node are numbers of bounds. ``made`` keeps what readers derive from it."""

    __slots__ = ("rows", "start", "end", "made", "tree", "kept")

    def __init__(self, tree: Tree, bounds: list[int] | None):
        self.tree, self.rows, self.made, self.kept = tree, flat(tree.roots), {}, bounds is not None
        places = bounds if bounds is not None else self.places()
        number = {x: k for k, x in enumerate(places)}
        self.start = np.array([number[r[0].start] for r in self.rows], np.int64)
        self.end = np.array([number[r[0].end] for r in self.rows], np.int64)

    def places(self) -> list[int]:
        return sorted({x for r in self.rows for x in (r[0].start, r[0].end)})


class Shapes:
    """The shapes that a process has met of one grammar."""

    _made: dict[str, Shapes] = {}

    def __init__(self, parser: Parser):
        self.parser = parser
        self.n_terminals = len(parser.grammar.terminals)
        self.walks = parser.scanner is None and self._lexer()
        #: Whether every cell of the tables has one action, so that one stack reads as the parser does.
        self.plain = all(len(x) <= 1 for row in parser.tables.actions for x in row.values())
        self.child = np.zeros((64, self.n_terminals), np.int32)
        self.begin = np.zeros(64, np.int32)
        self.shape_at: dict[int, Shape] = {}
        self.size, self.n_rows = 2, 0  # node 0 is off the trie, node 1 the root

    @classmethod
    def of(cls, grammar: str) -> Shapes:
        if grammar not in cls._made:
            cls._made[grammar] = cls(Parser.of(grammar))
        return cls._made[grammar]

    # the lexer

    def _lexer(self) -> bool:
        a = self.parser.automaton
        cuts = sorted({0, *(x for moves in a.moves for ranges, _ in moves for lo, hi in ranges for x in (lo, hi + 1) if x <= 0x10FFFF)})
        self.cuts = np.array(cuts, np.int64)
        self.ascii = (np.searchsorted(self.cuts, np.arange(128), "right") - 1).astype(np.int32)
        self.n_classes = len(cuts) + 1  # the last is the text's end
        self.known: dict[frozenset[int], int] = {}
        self.step = np.zeros((1, self.n_classes), np.int32)  # state 0 is dead
        self.takes = np.zeros(1, np.int64)
        rank = self.parser._rank
        self.level = {x: k + 1 for k, x in enumerate(sorted({v[0] for v in rank.values()}))}
        return True

    def _start(self, permitted: frozenset[int]) -> int:
        """The number of the lexer's state that begins where these terminals may stand; -1 if the lexer grows too large."""
        a, p = self.parser.automaton, self.parser
        first = a.start(permitted)
        todo, rows, takes = [], [], []

        def number(state: list) -> int:
            if state[2] not in self.known:
                self.known[state[2]] = len(self.known) + 1
                todo.append(state)
            return self.known[state[2]]

        out = number(first)
        for state in todo:
            if len(self.known) * self.n_classes > MOST_CELLS:
                self.walks = False
                return -1
            row = np.zeros(self.n_classes, np.int32)
            for c, at in enumerate(self.cuts.tolist()):
                to = state[0][chr(at)] if chr(at) in state[0] else a._move(state, chr(at))
                row[c] = number(to) if to is not None else 0
            rows.append(row)
            best = max(state[1], key=lambda j: (p._rank[p.terminal_of[j]][0], *p._standing(j)), default=None)
            takes.append(0 if best is None else self.level[p._rank[p.terminal_of[best]][0]] * _TERMINALS + p.terminal_of[best])
        if rows:
            self.step, self.takes = np.vstack([self.step, *rows]), np.append(self.takes, takes)
        return out

    # the trie

    def _add(self, log: list[tuple], shape: Shape) -> None:
        if not self.walks or self.n_rows + len(shape.rows) > MOST_ROWS or len(log) > MOST_TOKENS or (self.size + len(log)) * self.n_terminals > MOST_CELLS:
            return
        at = 1
        for wanted, loose, k, _ in log:
            if not self.begin[at] and (state := self._start(self.parser._permitted(wanted, loose))) >= 0:
                self.begin[at] = state
            if not self.walks:
                return
            if k == 0:
                if at not in self.shape_at:
                    self.shape_at[at] = shape
                    self.n_rows += len(shape.rows)
                return
            if not self.child[at, k]:
                if self.size == len(self.child):
                    self.child = np.vstack([self.child, np.zeros_like(self.child)])
                    self.begin = np.append(self.begin, np.zeros_like(self.begin))
                self.child[at, k] = self.size
                self.size += 1
            at = int(self.child[at, k])

    def _alone(self, text: str, mend: str) -> tuple[Shape, list[int]]:
        log: list[tuple] = []
        tree = self.parser.parse(text, mend, log=log)
        if self.walks and tree.stop == "accepted" and not tree.scars:
            bounds = [0, *(end for _, _, k, end in log if k)]
            shape = Shape(tree, bounds)
            self._add(log, shape)
            return shape, bounds
        shape = Shape(tree, None)
        return shape, shape.places()

    def _walk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(trie node at the end of each text or 0, number of tokens, where their ends begin, ends)"""
        n = len(texts)
        data = "".join(texts)
        if data.isascii():
            classes = self.ascii[np.frombuffer(data.encode(), np.uint8)]
        else:
            classes = (np.searchsorted(self.cuts, np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32), "right") - 1).astype(np.int32)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        first = np.cumsum(sizes + 1) - sizes - 1
        read = np.full(len(data) + n, self.n_classes - 1, np.int32)
        read[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = classes
        ends, count, final = np.zeros(len(data) + n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32)
        step, takes, n_classes = self.step.ravel(), self.takes, self.n_classes
        who, at, node = np.arange(n), first.copy(), np.ones(n, np.int32)
        empty = sizes == 0
        final[empty] = 1
        who, at, node = who[~empty], at[~empty], node[~empty]
        state, best, end = self.begin[node], np.zeros(len(who), np.int64), at.copy()
        while len(who) >= FEWEST or len(who) and n < FEWEST:
            state = step[state * n_classes + read[at]]
            at = at + 1
            took = takes[state]
            hit = took >= (best & -_TERMINALS)
            best, end = np.where(hit, took, best), np.where(hit, at, end)
            done = np.flatnonzero(state == 0)
            if not len(done):
                continue
            k = best[done] & (_TERMINALS - 1)
            to = np.where(best[done] > 0, self.child[node[done], k], 0)
            i, e = who[done], end[done]
            ends[first[i] + count[i]] = e - first[i]
            count[i] += 1
            node[done], at[done], end[done], best[done] = to, e, e, 0
            state[done] = self.begin[to]
            over = (to == 0) | (read[e] == n_classes - 1) | (self.begin[to] == 0)
            if over.any():
                whole = over & (read[e] == n_classes - 1)
                final[i[whole]] = to[whole]
                left = np.ones(len(who), bool)
                left[done[over]] = False
                who, at, node, state, best, end = who[left], at[left], node[left], state[left], best[left], end[left]
        return final, count, first, ends

    def read(self, texts: list[str], mend: str = "fell") -> Iterator[tuple[np.ndarray, Shape, np.ndarray]]:
        """(numbers of texts, their shape, their bounds, a row a text), each text in one of them."""
        begin = 0
        while begin < len(texts):
            stop, some = begin, 0
            while stop < len(texts) and (stop == begin or some + len(texts[stop]) <= MOST_CHARACTERS):
                some += len(texts[stop])
                stop += 1
            for which, shape, bounds in self._read(texts[begin:stop], mend):
                yield which + begin, shape, bounds
            begin = stop

    def _read(self, texts: list[str], mend: str):
        left, quota = np.arange(len(texts)), 8
        while len(left):
            if self.walks and self.size > 2:
                final, count, first, ends = self._walk([texts[i] for i in left.tolist()])
                order = np.argsort(final, kind="stable")
                cuts = np.flatnonzero(np.diff(final[order])) + 1
                missed = []
                for run in np.split(order, cuts):
                    shape = self.shape_at.get(int(final[run[0]]))
                    if shape is None:
                        missed.append(run)
                    else:
                        rows = first[run][:, None] + np.arange(count[run[0]])
                        yield left[run], shape, np.hstack([np.zeros((len(run), 1), np.int64), ends[rows]])
                left = left[np.sort(np.concatenate(missed))] if missed else left[:0]
            elif not self.walks:
                quota = len(left)
            for i in left[:quota].tolist():
                shape, bounds = self._alone(texts[i], mend)
                yield np.array([i]), shape, np.array([bounds], np.int64)
            left, quota = left[quota:], quota * 4
