"""Parsing one text to a tree: state-directed tokens, parallel readings where the grammar declares them, and repair."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from .grammar import Grammar, load
from .regex import Automaton
from .scanner import FRAMES, Memory, Scanner
from .tables import ACCEPT, REDUCE, SHIFT, Tables, build

NOTHING: frozenset[int] = frozenset()
#: Readings that are followed at once.
MAX_READINGS = 64
#: Rings that a text keeps; beyond them every second one goes.
MOST_RINGS = 256
#: Repair ends once more of a text is skipped than this share of it.
MOST_SKIPPED = 0.75
#: Stop; drop the token and go on; also fell the stack into roots and begin anew; drop one token, then fell.
MENDS = ("none", "keep", "fell", "relent")


class Node:
    __slots__ = ("kind", "under", "named", "hidden", "extra", "renamed", "field", "start", "end", "kids", "count", "heft")

    def __init__(self, kind, under, named, hidden, start, end, kids=(), extra=False):
        self.kind, self.under, self.named, self.hidden = kind, under, named, hidden
        self.extra, self.renamed, self.field = extra, False, None
        self.start, self.end, self.kids, self.heft = start, end, kids, 0
        # A hidden node owns the first ``count`` of a list that its successors go on writing, so that a run of n takes n steps.
        self.count = len(kids)

    def copy(self) -> Node:
        n = Node(self.kind, self.under, self.named, self.hidden, self.start, self.end, self.kids, self.extra)
        n.renamed, n.field, n.heft, n.count = self.renamed, self.field, self.heft, self.count
        return n

    def run(self):
        return self.kids if len(self.kids) == self.count else self.kids[: self.count]


@dataclass
class Scar:
    at: int
    over: int
    gave: str | None
    heads: int
    shifted: int
    felled: bool
    why: str


@dataclass
class Tree:
    roots: list[Node]
    stop: str
    at: int
    symbol: str | None
    state: int | None
    mends: int = 0
    skipped: int = 0
    supplied: int = 0
    spurned: int = 0
    scars: list[Scar] = field(default_factory=list)
    #: Roots of stacks that repair has felled, in order.
    felled: list[Node] = field(default_factory=list)

    def copy(self) -> Tree:
        return replace(self, scars=list(self.scars), felled=list(self.felled))


class Head:
    """A stack as a linked list; extras lie on it like nodes that no rule counts."""

    __slots__ = ("state", "node", "below", "heft")

    def __init__(self, state: int, node: Node | None, below: Head | None, heft: int):
        self.state, self.node, self.below, self.heft = state, node, below, heft

    def states(self) -> tuple[int, ...]:
        out, h = [], self
        while h:
            out.append(h.state)
            h = h.below
        return tuple(out)


class Ring(NamedTuple):
    """A place between two tokens from which a parse can go on. Heads share their stacks, so a ring is small."""

    at: int
    #: The first character that nothing before this place has looked at.
    reach: int
    heads: list[Head]
    loose: bool
    shifted: int
    tree: Tree
    broken: bool


class Parser:
    """A compiled grammar. It pickles as its source and compiles once in a process."""

    _made: dict[str, Parser] = {}

    def __init__(self, source: str):
        self.source = source
        self.grammar, trees = load(source)
        self.tables: Tables = build(self.grammar)
        known = [(k, t) for k, t in enumerate(trees) if t is not None]
        self.terminal_of = [k for k, _ in known]
        self.place_of = {k: j for j, (k, _) in enumerate(known)}
        self.automaton = Automaton([t for _, t in known])
        g = self.grammar
        self._rank = {}
        for k in self.terminal_of:
            t = g.terminals[k]
            standing = 0 if k in g.extras else (5 if t.kind == "literal" else 3) + t.immediate
            self._rank[k] = (t.prec, standing)
        self._permits: dict = {}
        self._begin: dict[tuple[int, bool], tuple[list, bool]] = {}
        self._standing = lambda j: (self._rank[self.terminal_of[j]][1], -j)
        self._wanted = [self.tables.permitted(s) for s in range(len(self.tables.actions))]
        self._leaves = [(t.name, t.shape == "named", t.shape == "hidden") for t in g.terminals]
        self._plans = [(len(p.steps), g.symbol_name(p.lhs), g.shape(p.lhs)) for p in g.productions]
        book = (json.loads(source) if isinstance(source, str) else source).get("scanner")
        self.scanner = Scanner(book, {t.name: k for k, t in enumerate(self.grammar.terminals) if k}) if book else None

    @classmethod
    def of(cls, source: str) -> Parser:
        if source not in cls._made:
            cls._made[source] = cls(source)
        return cls._made[source]

    def __reduce__(self):
        return Parser.of, (self.source,)

    # tokens

    def _permitted(self, wanted: frozenset[int], loose: bool) -> frozenset[int]:
        key = (wanted, loose)
        if key not in self._permits:
            g = self.grammar
            self._permits[key] = frozenset(self.place_of[k] for k in wanted | {x for x in g.extras if g.is_terminal(x)} if k in self.place_of and not (loose and g.terminals[k].immediate))
        return self._permits[key]

    def _token_in(self, text: str, at: int, state: int, loose: bool) -> tuple[int, int] | None:
        """The token that one state reads next: by the longest match alone where all that it permits has one precedence."""
        got = self._begin.get((state, loose))
        if got is None:
            permitted = self._permitted(self._wanted[state], loose)
            even = len({self._rank[self.terminal_of[j]][0] for j in permitted}) <= 1
            got = self._begin[state, loose] = self.automaton.start(permitted), even
        if not got[1]:
            return self.token(text, at, self._wanted[state], loose)
        found = self.automaton.best(text, at, got[0], self._standing)
        return found and (self.terminal_of[found[0]], found[1])

    def token(self, text: str, at: int, wanted: frozenset[int], loose: bool) -> tuple[int, int] | None:
        """(terminal, end) of the next token among the wanted and extras; immediate ones only when not ``loose``.

        The highest precedence first, in it the longest, then literal before pattern, then the lowest number.
        """
        permitted = self._permitted(wanted, loose)
        found = self.automaton.each(text, at, permitted)
        if not found:
            return None
        if len(found) == 1:
            ((place, end),) = found.items()
            return self.terminal_of[place], end
        rank = self._rank
        best = max(found, key=lambda j: (rank[self.terminal_of[j]][0], found[j], rank[self.terminal_of[j]][1], -j))
        return self.terminal_of[best], found[best]

    def tokenize(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(symbol, start, end, extra) with every terminal permitted, up to the first place where none matches."""
        g = self.grammar
        every = frozenset(k for k in self.terminal_of)
        out, at, loose = [], 0, False
        memory, spent, everything = Memory(), [], frozenset(range(1, len(g.terminals)))
        while at < len(text):
            if (answer := self._asked(text, at, everything, memory, not loose, spent)) and answer.end > at:
                k, at, end = answer
            elif got := self.token(text, at, every, loose):
                k, end = got
            else:
                break
            if k not in g.extras or g.terminals[k].shape == "named":
                out.append((g.terminals[k].name, at, end, k in g.extras))
            loose = k in g.extras
            at = end
        return out

    def _asked(self, text: str, at: int, wanted: frozenset[int], memory: Memory, fresh: bool, spent: list[tuple[int, int]]):
        """The scanner's answer; ``spent`` holds the answers without width at this place, each of which may come a bounded number of times."""
        if self.scanner is None:
            return None
        if spent:
            spent[:] = [x for x in spent if x[0] == at]
        here = [k for _, k in spent]
        answer = self.scanner.ask(text, at, wanted, memory, fresh, frozenset(k for k in here if here.count(k) > FRAMES) if len(here) > FRAMES else NOTHING)
        if answer and answer.end == at:
            spent.append((at, answer.terminal))
        return answer

    # trees

    def _leaf(self, k: int, start: int, end: int, extra: bool = False) -> Node:
        name, named, hidden = self._leaves[k]
        return Node(name, name, named, hidden, start, end, (), extra)

    def _reduce(self, head: Head, p: int) -> Head:
        production = self.grammar.productions[p]
        need, name, shape = self._plans[p]
        trailing, nodes, h, heft = [], [], head, head.heft
        while need:
            if h.node.extra and not nodes:
                trailing.append(h.node)
            else:
                nodes.append(h.node)
                need -= not h.node.extra
            h = h.below
        nodes.reverse()
        kids: list[Node] = []
        j = 0
        if len(nodes) > 1 and nodes[0].hidden and nodes[0].count and shape != "named" and not (production.steps[0].alias or production.steps[0].field):
            kids, j = nodes[0].run(), 1
        for n in nodes[j:]:
            if n.extra:
                kids.append(n)
                continue
            step = production.steps[j]
            j += 1
            if step.alias:
                n = n.copy()
                n.kind, n.named, n.hidden, n.renamed = step.alias[0], step.alias[1], False, True
            if n.hidden and not step.field:
                kids += n.run()
            elif n.hidden:
                for kid in n.run():
                    if not kid.extra and kid.field is None:
                        kid = kid.copy()
                        kid.field = step.field
                    kids.append(kid)
            else:
                if step.field:
                    if not step.alias:
                        n = n.copy()
                    n.field = step.field
                kids.append(n)
        start = end = -1
        for n in nodes:
            if n.end > n.start and not n.extra:
                start, end = n.start if start < 0 else start, n.end
        if start < 0:
            start = end = h.node.end if h.node else 0
        new = Node(name, name, shape == "named", shape != "named", start, end, kids)
        out = Head(self.tables.edges[h.state][production.lhs], new, h, heft + production.dynamic)
        for n in reversed(trailing):
            out = Head(out.state, n, out, out.heft)
        return out

    def absorb(self, heads: list[Head], k: int, leaf: Node | None) -> tuple[list[Head], Head | None]:
        """(heads after the terminal, the accepted head); empty if every head refuses it."""
        if len(heads) == 1:  # no choice as far as it goes
            head = heads[0]
            while len(offers := self.tables.actions[head.state].get(k, ())) == 1:
                verb, x = offers[0]
                if verb == SHIFT:
                    return [Head(x, leaf, head, head.heft)], None
                if verb == ACCEPT:
                    return [], head
                head = self._reduce(head, x)
            heads = [head]
        out, done, todo = [], None, list(heads)
        while todo:
            head = todo.pop()
            for verb, x in self.tables.actions[head.state].get(k, ()):
                if verb == SHIFT:
                    out.append(Head(x, leaf, head, head.heft))
                elif verb == REDUCE:
                    todo.append(self._reduce(head, x))
                elif verb == ACCEPT and (done is None or head.heft > done.heft):
                    done = head
        if len(out) > 1:
            best: dict = {}
            for h in out:
                key = h.states()
                if key not in best or h.heft > best[key].heft:
                    best[key] = h
            out = sorted(best.values(), key=lambda h: -h.heft)[:MAX_READINGS]
        return out, done

    def parse(self, text: str, mend: str = "fell", rings: list[Ring] | None = None, stride: int = 16, log: list[tuple] | None = None) -> Tree:
        """A tree on every outcome: whole, or a forest of what was built.

        With ``rings``, parsing goes on from the last of them, and leaves one every ``stride`` tokens. ``log`` takes (wanted, loose, terminal, end) of each.
        """
        if mend not in MENDS:
            raise ValueError(f"mend is one of {', '.join(MENDS)}")
        g = self.grammar
        heads, at, loose, shifted = [Head(0, None, None, 0)], 0, False, 0
        tree = Tree([], "accepted", len(text), None, None)
        broken, memory, spent, kept = False, Memory(), [], -1
        self.automaton.reach = 0
        if rings:
            at, self.automaton.reach, heads, loose, shifted, tree, broken = rings[-1]
            tree = tree.copy()
            tree.at = tree.at if broken else len(text)

        def stop(kind: str, where: int, symbol: str | None) -> None:
            nonlocal broken
            if not broken:
                tree.stop, tree.at, tree.symbol, tree.state, broken = kind, where, symbol, heads[0].state, True

        while True:
            one = len(heads) == 1
            wanted = self._wanted[heads[0].state] if one else frozenset().union(*(self._wanted[h.state] for h in heads))
            if rings is not None and self.scanner is None and shifted % stride == 0 and (not rings or shifted > rings[-1].shifted):
                if len(rings) >= MOST_RINGS:
                    del rings[1:-1:2]
                rings.append(Ring(at, self.automaton.reach, heads, loose, shifted, tree.copy(), broken))
            if self.scanner and (answer := self._asked(text, at, wanted, memory, not loose, spent)):
                k, at, end = answer
            elif at >= len(text):
                k, end = 0, at
            else:
                got = self._token_in(text, at, heads[0].state, loose) if one else self.token(text, at, wanted, loose)
                if got is None:  # name what stands here by the unrestricted terminals
                    end, found = self.automaton.shortest(text, at, frozenset(range(len(self.terminal_of))))
                    k, end = (self.terminal_of[found[0]], end) if found else (-1, at + 1)
                else:
                    k, end = got
            if log is not None:
                log.append((wanted, loose, k, end))
            if k in g.extras and k not in wanted:
                if g.terminals[k].shape == "named":
                    heads = [Head(h.state, self._leaf(k, at, end, True), h, h.heft) for h in heads]
                at, loose = end, True
                continue
            after, done = self.absorb(heads, k, self._leaf(k, at, end) if k > 0 else None) if k >= 0 else ([], None)
            if done:
                tree.roots = tree.felled + self._crown(done, text)
                return tree
            if after:
                heads, at, loose = after, end, False
                shifted += 1
                continue
            stop("stray" if k < 0 else "truncated" if k == 0 else "unexpected", at, g.symbol_name(k) if k >= 0 else None)
            if mend == "none" or tree.skipped > MOST_SKIPPED * len(text):
                break
            given = self._supply(heads, k, at) if k >= 0 and mend != "keep" else []
            if len(given) == 1:
                name, heads = given[0]
                tree.supplied += 1
                tree.scars.append(Scar(at, at, name, len(heads), shifted, False, "supplied"))
                continue
            tree.spurned += len(given) > 1
            if k == 0:
                break
            if end == at:  # an answer without width that no head takes isn't asked for again here
                spent.extend([(at, k)] * (FRAMES + 1))
                continue
            tree.mends += 1
            tree.skipped += end - at
            fell = mend == "fell" or mend == "relent" and kept == shifted
            tree.scars.append(Scar(at, end, None, len(heads), shifted, fell, "stray" if k < 0 else "unexpected"))
            if fell:
                tree.felled += self._forest(max(heads, key=lambda h: h.heft))
                heads, memory = [Head(0, None, None, 0)], Memory()
            kept = -1 if fell else shifted
            at, loose = end, True
        tree.roots = tree.felled + self._forest(max(heads, key=lambda h: h.heft))
        return tree

    def _supply(self, heads: list[Head], k: int, at: int) -> list[tuple[str, list[Head]]]:
        """Literals of no width after which the refused terminal can be read."""
        out = []
        for t in sorted({t for h in heads for t in self.tables.permitted(h.state)}):
            if t and self.grammar.terminals[t].kind == "literal":
                after, _ = self.absorb(heads, t, self._leaf(t, at, at))
                if after:
                    more, done = self.absorb(after, k, self._leaf(k, at, at) if k else None)
                    if more or done:
                        out.append((self.grammar.terminals[t].name, after))
        return out

    @staticmethod
    def _forest(head: Head) -> list[Node]:
        out = []
        while head.node:
            out.extend(reversed(head.node.run()) if head.node.hidden else [head.node])
            head = head.below
        return out[::-1]

    def _crown(self, head: Head, text: str) -> list[Node]:
        """The root takes the extras around it and reaches the text's end."""
        after, before = [], []
        while head.node.extra:
            after.append(head.node)
            head = head.below
        root = head.node.copy()
        below = head.below
        while below.node:
            before.append(below.node)
            below = below.below
        root.kids = [*before[::-1], *root.kids, *after[::-1]]
        root.start = min([root.start, *(k.start for k in root.kids[:1])])
        root.end = len(text)
        return [root]


def flat(roots: list[Node]) -> list[tuple]:
    """(node, pre, parent pre or -1, place, named place or -1, depth, last) in preorder, without recursion."""
    out: list[list] = []
    todo = [(n, -1, k, k, 0) for k, n in reversed(list(enumerate(roots)))]
    while todo:
        n, parent, place, named, depth = todo.pop()
        pre = len(out)
        out.append([n, pre, parent, place, named if n.named else -1, depth, pre])
        named, kids = 0, []
        for k, kid in enumerate(n.kids):
            kids.append((kid, pre, k, named, depth + 1))
            named += kid.named
        todo.extend(reversed(kids))
    for row in reversed(out):
        if row[2] >= 0 and out[row[2]][6] < row[6]:
            out[row[2]][6] = row[6]
    return out


def grammar_of(source: str) -> Grammar:
    return Parser.of(source).grammar
