"""What a run of tokens does to a parser's stack, as elements that compose.

An effect says: entered in this state, the run took these symbols off, each standing on one of these states, and left
those symbols in their place. Composition is associative and partial: None means that the two were never neighbours.
So the effect of a text is the ordered product of its segments' effects, however they are grouped.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from .parser import Parser
from .tables import ACCEPT, REDUCE, SHIFT, Tables

#: Bounds of a segment's possible effects: runs followed at once, and guesses below the base for one reduction.
MOST_RUNS, MOST_GUESSES = 256, 16


@dataclass(frozen=True)
class Effect:
    """``guard[d - 1]`` is the symbol taken at depth d with the states it may stand on; ``push`` is bottom first."""

    entry: int | None = None
    guard: tuple[tuple[int, frozenset[int]], ...] = ()
    push: tuple[int, ...] = ()
    hole: bool = False

    @property
    def reaches(self) -> int:
        return len(self.guard)

    @property
    def grounded(self) -> bool:
        """Whether the run may begin a text, where nothing lies below."""
        return not self.guard and not self.hole

    @property
    def shape(self) -> tuple[int, tuple[int, ...]]:
        return len(self.guard), self.push


IDENTITY = Effect()
#: A stretch that repair has stepped over: nothing composes with it.
HOLE = Effect(hole=True)


def shift(state: int, terminal: int) -> Effect:
    return Effect(state, (), (terminal,))


def reduce(t: Tables, under: int, rhs: Iterable[int], lhs: int) -> Effect | None:
    """Taking a right-hand side off and putting its left-hand side on; None if no such parse is."""
    guard, at = [], under
    for symbol in rhs:
        guard.append((symbol, frozenset([at])))
        if symbol not in t.edges[at]:
            return None
        at = t.edges[at][symbol]
    return Effect(at, tuple(reversed(guard)), (lhs,)) if lhs in t.edges[under] else None


def compose(t: Tables, a: Effect | None, b: Effect | None) -> Effect | None:
    if a is None or b is None or a.hole or b.hole:
        return None
    if a.entry is None:
        return b
    if b.entry is None:
        return a
    left, taken = len(a.push), len(b.guard)

    def survives(state: int) -> bool:
        for height, symbol in enumerate(a.push):
            depth = left - height
            if depth <= taken and (b.guard[depth - 1][0] != symbol or state not in b.guard[depth - 1][1]):
                return False
            if symbol not in t.edges[state]:
                return False
            state = t.edges[state][symbol]
        return state == b.entry

    base = a.guard[-1][1] if a.guard else frozenset([a.entry])
    kept = frozenset(s for s in base if survives(s))
    if not kept:
        return None
    guard = (*a.guard[:-1], (a.guard[-1][0], kept)) if a.guard else ()
    if left >= taken:
        return Effect(a.entry, guard, (*a.push[: left - taken], *b.push))
    return Effect(a.entry, (*guard, *b.guard[left:]), b.push)


def fold(t: Tables, effects: Iterable[Effect | None]) -> Effect | None:
    out: Effect | None = IDENTITY
    for e in effects:
        out = compose(t, out, e)
    return out


# sets of states, and columns of them


def meet(a: tuple, b: tuple) -> tuple | None:
    """What both guards claim; None if they contradict each other. The deeper one keeps its tail."""
    out = []
    for (x, s), (y, r) in zip(a, b, strict=False):
        if x != y or not s & r:
            return None
        out.append((x, s & r))
    return (*out, *(a if len(a) > len(b) else b)[len(out) :])


def join(a: tuple, b: tuple) -> tuple | None:
    """The weakest guard that either implies; None unless they take the same symbols."""
    if [x for x, _ in a] != [x for x, _ in b]:
        return None
    return tuple((x, s | r) for (x, s), (_, r) in zip(a, b, strict=True))


def merged(effects: Iterable[Effect]) -> list[Effect]:
    """Effects that differ in the states of one depth only become one, which loses nothing."""
    out: list[Effect] = []
    for e in effects:
        for k, o in enumerate(out):
            both = join(e.guard, o.guard) if (e.entry, e.push) == (o.entry, o.push) else None
            if both is not None and sum(x != y for x, y in zip(e.guard, o.guard, strict=True)) <= 1:
                out[k] = replace(o, guard=both)
                break
        else:
            out.append(e)
    return out


# runs


def before(t: Tables) -> list[dict[int, list[int]]]:
    """Of each state, the states from which a symbol leads to it."""
    out: list[dict[int, list[int]]] = [{} for _ in t.edges]
    for s, row in enumerate(t.edges):
        for symbol, to in row.items():
            out[to].setdefault(symbol, []).append(s)
    return out


def possible(t: Tables, terminals: list[int], entries: Iterable[int] | None = None) -> list[Effect]:
    """Every effect that a run of terminals may have, over all states it may be entered in."""
    back, done = before(t), []
    runs = [(Effect(s, (), ()), s, 0) for s in (range(len(t.edges)) if entries is None else entries)]
    while runs:
        if len(runs) > MOST_RUNS * len(t.edges):
            raise OverflowError("a run of tokens has too many possible effects")
        e, state, k = runs.pop()
        if k == len(terminals):
            done.append(e)
            continue
        for verb, x in t.actions[state].get(terminals[k], ()):
            if verb == SHIFT:
                runs.append((replace(e, push=(*e.push, terminals[k])), x, k + 1))
            elif verb == REDUCE:
                p = t.grammar.productions[x]
                need = len(p.steps) - len(e.push)
                base = next(iter(e.guard[-1][1])) if e.guard else e.entry
                guesses = [(e.guard, base)]
                for step in reversed(p.steps[: max(need, 0)]):
                    guesses = [((*g, (step.symbol, frozenset([s]))), s) for g, b in guesses for s in back[b].get(step.symbol, ())]
                if len(guesses) > MOST_GUESSES * len(t.edges):
                    raise OverflowError("a reduction has too many possible places")
                kept = e.push[: len(e.push) - len(p.steps)] if need <= 0 else ()
                for guard, b in guesses:
                    top = b
                    for symbol in kept:
                        top = t.edges[top][symbol]
                    if p.lhs in t.edges[top]:
                        runs.append((Effect(e.entry, guard, (*kept, p.lhs)), t.edges[top][p.lhs], k))
    return merged(done)


def trail(parser: Parser, text: str) -> tuple[list[list[Effect]], bool]:
    """(moves of each token as effects, whether the text is accepted) by one stack and no tree; it ends at the first refusal.

    A cell with several actions takes its first, so this is also a check of a parser that keeps them all.
    """
    t, g, stack, at, loose = parser.tables, parser.grammar, [(0, -1)], 0, False
    out: list[list[Effect]] = []
    while True:
        wanted = t.permitted(stack[-1][0])
        got = (0, at) if at >= len(text) else parser.token(text, at, wanted, loose)
        if got is None:
            return out, False
        k, end = got
        if k in g.extras and k not in wanted:
            at, loose = end, True
            continue
        moves: list[Effect] = []
        while True:
            offers = t.actions[stack[-1][0]].get(k)
            if not offers:
                return out, False
            verb, x = offers[0]
            if verb == ACCEPT:
                return [*out, moves], True
            if verb == SHIFT:
                moves.append(shift(stack[-1][0], k))
                stack.append((x, k))
                break
            p = g.productions[x]
            rhs = [s.symbol for s in p.steps]
            under = stack[len(stack) - len(rhs) - 1][0]
            moves.append(reduce(t, under, rhs, p.lhs))
            del stack[len(stack) - len(rhs) :]
            stack.append((t.edges[under][p.lhs], p.lhs))
        out.append(moves)
        at, loose = end, False
