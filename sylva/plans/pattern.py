"""Tree patterns: reading them, checking their names against a grammar, and matching them on one tree."""

from __future__ import annotations

import re
from dataclasses import dataclass
from dataclasses import field as fresh

from .grammar import Grammar

MAX_DEPTH = 64
_WORD = re.compile(r"[A-Za-z0-9_.\-]+")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}
ARITY = {"eq?": 2, "not-eq?": 2, "match?": 2, "not-match?": 2, "any-of?": None, "not-any-of?": None}


class PatternError(ValueError):
    """A pattern that can't be read or names what the grammar lacks; ``at`` is the character, ``word`` the name."""

    def __init__(self, what: str, at: int, word: str = "", source: str = ""):
        line, column = source.count("\n", 0, at) + 1, at - (source.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{what}{f' {word!r}' if word else ''} at {line}:{column}")
        self.what, self.at, self.word = what, at, word


@dataclass
class Item:
    """One place in a sequence of siblings."""

    shape: str  # kind, any, named, literal, group, choice
    name: str = ""
    super_: str = ""
    at: int = 0
    field: str | None = None
    absent: list[str] = fresh(default_factory=list)
    kids: list[Item] = fresh(default_factory=list)  # members of a group or choice too
    captures: list[str] = fresh(default_factory=list)
    quantifier: str = ""
    anchored: bool = False
    closed: bool = False


@dataclass
class Pattern:
    root: Item
    predicates: list[tuple[str, list[tuple[str, str]]]] = fresh(default_factory=list)
    dead: str | None = None
    at: int = 0


def read(source: str) -> list[Pattern]:
    at = 0

    def fail(what: str, where: int | None = None, word: str = ""):
        raise PatternError(what, at if where is None else where, word, source)

    def skip() -> None:
        nonlocal at
        while at < len(source):
            if source[at].isspace():
                at += 1
            elif source[at] == ";":
                end = source.find("\n", at)
                at = len(source) if end < 0 else end
            else:
                return

    def peek(text: str) -> bool:
        skip()
        return source.startswith(text, at)

    def take(text: str) -> bool:
        nonlocal at
        if peek(text):
            at += len(text)
            return True
        return False

    def word() -> str:
        nonlocal at
        skip()
        m = _WORD.match(source, at)
        if not m:
            fail("a name is expected")
        at = m.end()
        return m[0]

    def string() -> str:
        nonlocal at
        start, out = at, []
        at += 1
        while at < len(source) and source[at] != '"':
            if source[at] == "\\" and at + 1 < len(source):
                at += 1
                out.append(_ESCAPES.get(source[at], source[at]))
            else:
                out.append(source[at])
            at += 1
        if at >= len(source):
            fail("open string", start)
        at += 1
        return "".join(out)

    def modifiers(item: Item) -> Item:
        nonlocal at
        while True:
            if take("@"):
                item.captures.append(word())
            elif not item.quantifier and (peek("?") or peek("*") or peek("+")):
                item.quantifier = source[at]
                at += 1
            else:
                return item

    def predicate() -> tuple[str, list[tuple[str, str]]]:
        start, args = at, []
        name = word()
        for mark in "?!":
            if source.startswith(mark, at):
                name += mark
                advance()
                break
        else:
            fail("a predicate ends in ? or !", start, name)
        while not take(")"):
            if at >= len(source):
                fail("open predicate", start)
            if take("@"):
                args.append(("capture", word()))
            elif peek('"'):
                args.append(("text", string()))
            else:
                args.append(("text", word()))
        if name in ARITY:
            want = ARITY[name]
            if want and len(args) != want or want is None and len(args) < 2:
                fail("wrong number of arguments", start, name)
            if args[0][0] != "capture" or name not in ("eq?", "not-eq?") and any(k != "text" for k, _ in args[1:]):
                fail("wrong kind of argument", start, name)
            if "match" in name:
                try:
                    re.compile(args[1][1])
                except re.error:
                    fail("bad regular expression", start, args[1][1])
        return name, args

    def advance() -> None:
        nonlocal at
        at += 1

    def sequence(end: str, depth: int, owner: Item, predicates: list | None) -> None:
        anchored = False
        start = at
        while not take(end):
            if at >= len(source):
                fail("open parenthesis", start)
            if peek("(#"):
                take("(#")
                if predicates is None:
                    fail("a predicate belongs to a pattern")
                predicates.append(predicate())
            elif take("!"):
                owner.absent.append(word())
            elif peek(".") :
                take(".")
                anchored = True
            else:
                kid = element(depth + 1, predicates)
                kid.anchored, anchored = anchored, False
                owner.kids.append(kid)
        owner.closed = anchored

    def element(depth: int, predicates: list | None) -> Item:
        skip()
        start = at
        if depth > MAX_DEPTH:
            fail("too deep")
        if take("["):
            item = Item("choice", at=start)
            while not take("]"):
                if at >= len(source):
                    fail("open bracket", start)
                item.kids.append(element(depth + 1, predicates))
            if not item.kids:
                fail("empty choice", start)
        elif take("("):
            if peek("(") or peek("[") or peek('"') or peek("."):
                item = Item("group", at=start)
                sequence(")", depth, item, predicates)
            else:
                name = word()
                item = Item("named" if name == "_" else "kind", "" if name == "_" else name, at=start)
                if source.startswith("/", at):
                    advance()
                    item.super_, item.name = item.name, word()
                sequence(")", depth, item, predicates)
        elif peek('"'):
            item = Item("literal", string(), at=start)
        else:
            name = word()
            if take(":"):
                item = element(depth + 1, predicates)
                item.field = name
                return item
            if name != "_":
                fail("a pattern is expected", start, name)
            item = Item("any", at=start)
        return modifiers(item)

    out = []
    while True:
        skip()
        if at >= len(source):
            return out
        if peek("(#"):
            fail("a predicate belongs to a pattern")
        predicates: list = []
        start = at
        root = element(0, predicates)
        if root.quantifier:
            fail("a quantifier has no place at the top", start)
        names = set(_captures(root))
        for _, args in predicates:
            for k, v in args:
                if k == "capture" and v not in names:
                    fail("unknown capture", start, v)
        out.append(Pattern(root, predicates, at=start))


def _captures(item: Item):
    yield from item.captures
    for k in item.kids:
        yield from _captures(k)


def compile_(source: str, g: Grammar) -> list[Pattern]:
    """Patterns whose names are all the grammar's; those that can never match say why in ``dead``."""
    patterns = read(source)
    carried: dict[str, set[str]] = {}
    shown: dict[str, set[str]] = {}
    for kind in g.kinds:
        carried[kind], shown[kind] = _inside(g, kind)
    for p in patterns:
        _check(p, p.root, g, source, carried, shown)
    return patterns


def _inside(g: Grammar, kind: str) -> tuple[set[str], set[str]]:
    """(fields, kinds and literals) that a node of this kind may have among its children, hidden rules spliced."""
    fields: set[str] = set()
    kinds: set[str] = {g.symbol_name(x) for x in g.extras}
    worn = {s.symbol for p in g.productions for s in p.steps if s.alias and s.alias[0] == kind}
    todo = [s for s in range(g.size) if g.symbol_name(s) == kind or s in worn]
    seen = set(todo)
    for s in todo:
        for k in g.by_lhs.get(s, ()):
            for step in g.productions[k].steps:
                if step.field:
                    fields.add(step.field)
                if step.alias:
                    kinds.add(step.alias[0])
                elif g.shape(step.symbol) != "hidden":
                    kinds.add(g.symbol_name(step.symbol))
                elif step.symbol not in seen:
                    seen.add(step.symbol)
                    todo.append(step.symbol)
    return fields, kinds


def _check(p: Pattern, item: Item, g: Grammar, source: str, carried: dict, shown: dict) -> None:
    def dead(cause: str) -> None:
        p.dead = p.dead or cause

    if item.shape == "kind" and item.name not in g.kinds | set(g.supertypes):
        raise PatternError("unknown kind", item.at, item.name, source)
    if item.super_ and item.super_ not in g.supertypes:
        raise PatternError("unknown supertype", item.at, item.super_, source)
    if item.shape == "literal" and item.name not in g.literals:
        raise PatternError("unknown literal", item.at, item.name, source)
    for f in [*item.absent, *([item.field] if item.field else [])]:
        if f not in g.fields:
            raise PatternError("unknown field", item.at, f, source)
    if item.super_ and item.name not in g.members[item.super_]:
        dead("not_a_member")
    if item.shape == "kind" and item.name in carried and not item.super_:
        for kid in item.kids:
            if kid.quantifier in ("?", "*"):
                continue
            if kid.field and kid.field not in carried[item.name]:
                dead("field_not_carried")
            elif kid.shape in ("kind", "literal") and kid.name not in shown[item.name] and not (kid.name in g.members and g.members[kid.name] & shown[item.name]):
                dead("child_not_admitted")
    for kid in item.kids:
        _check(p, kid, g, source, carried, shown)


class Matcher:
    """Patterns over one tree, given as the rows of ``parser.flat`` in preorder."""

    def __init__(self, patterns: list[Pattern], g: Grammar, foreign: str = "refuse"):
        if foreign not in ("refuse", "admit", "deny"):
            raise ValueError("foreign is refuse, admit or deny")
        self.patterns, self.foreign = patterns, foreign
        self.members = g.members
        for p in patterns:
            for name, _ in p.predicates:
                if name.endswith("?") and name not in ARITY and foreign == "refuse":
                    raise PatternError("unknown predicate", p.at, name)
        self._regex = {a[1][1]: re.compile(a[1][1]) for p in patterns for n, a in p.predicates if "match?" in n}
        self.by_kind: dict[str, list[int]] = {}
        self.anywhere: list[int] = []
        for k, p in enumerate(patterns):
            if not p.dead:
                if p.root.shape in ("kind", "literal") and p.root.name not in self.members:
                    self.by_kind.setdefault(p.root.name, []).append(k)
                else:
                    self.anywhere.append(k)

    def matches(self, rows: list[tuple], text: str) -> list[tuple[int, int, int, list[tuple[str, int]]]]:
        """(pattern, finish, opened, captures (name, preorder rank)) in order of output."""
        out = []
        for found in self.structures(rows):
            tests = self.tests(found)
            k, finish, opened, caps = found
            word = lambda v: text[rows[v][0].start : rows[v][0].end] if isinstance(v, int) else v
            if tests is not None and all(ask(*map(word, values)) for ask, values in tests):
                out.append((k, rows[finish][0].start, rows[opened][0].start, caps))
        return out

    def structures(self, rows: list[tuple]) -> list[tuple[int, int, int, list[tuple[str, int]]]]:
        """(pattern, node of the finish, root, captures) in order of output, before predicates: what a tree's texts have no part in."""
        self.rows = rows
        self.children: list[list[int]] = [[] for _ in rows]
        top = []
        for n, pre, parent, *_ in rows:
            (self.children[parent] if parent >= 0 else top).append(pre)
        self.top = top
        out = []
        for n, pre, *_ in rows:
            for k in sorted([*self.by_kind.get(n.kind, ()), *self.anywhere]):
                for caps in self._at_root(self.patterns[k].root, pre):
                    last = caps[-1][1] if caps else pre
                    out.append((rows[last][0].start, n.start, k, len(out), last, pre, caps))
        out.sort(key=lambda m: m[:4])
        return [(k, last, pre, caps) for _, _, k, _, last, pre, caps in out]

    def _at_root(self, item: Item, pre: int):
        if item.shape == "group":
            siblings = self.children[self.rows[pre][2]] if self.rows[pre][2] >= 0 else self.top
            start = siblings.index(pre)
            got = self._sequence(item.kids, 0, siblings, start, item.closed, pinned=True)
            if got is not None:
                yield got[0]
            return
        if item.shape == "choice":
            for arm in item.kids:
                if arm.shape != "group" and self._fits(arm, pre):
                    for caps in self._at_root(arm, pre):
                        yield [(c, pre) for c in item.captures] + caps
                    return
            return
        if not self._fits(item, pre):
            return
        own = [(c, pre) for c in item.captures]
        if not item.kids:
            if not item.closed or not any(self.rows[c][0].named for c in self.children[pre]):
                yield own
            return
        kids, at = self.children[pre], 0
        while at < len(kids):
            got = self._sequence(item.kids, 0, kids, at, item.closed, began=at > 0)
            if got is None:
                break
            caps, end, first = got
            yield own + caps
            if end <= at and first < 0 or item.kids[0].anchored:
                break
            at = max(end, at + 1)

    def _fits(self, item: Item, pre: int) -> bool:
        n = self.rows[pre][0]
        if item.field and n.field != item.field:
            return False
        if item.shape == "literal":
            ok = not n.named and n.kind == item.name
        elif item.shape == "named":
            ok = n.named
        elif item.shape == "kind":
            ok = n.named and (n.kind == item.name or item.name in self.members and n.kind in self.members[item.name])
            ok = ok and (not item.super_ or n.kind in self.members.get(item.super_, ()))
        else:
            ok = item.shape in ("any", "choice")
        return ok and not any(self.rows[c][0].field in item.absent for c in self.children[pre] if item.absent)

    def _one(self, item: Item, pre: int):
        """First captures of a node under an item, or None."""
        if item.shape == "choice":
            if item.field and self.rows[pre][0].field != item.field:
                return None
            for arm in item.kids:
                got = self._one(arm, pre) if arm.shape != "group" else None
                if got is not None:
                    return [(c, pre) for c in item.captures] + got
            return None
        if not self._fits(item, pre):
            return None
        own = [(c, pre) for c in item.captures]
        if not item.kids:
            return own if not item.closed or not any(self.rows[c][0].named for c in self.children[pre]) else None
        got = self._sequence(item.kids, 0, self.children[pre], 0, item.closed)
        return None if got is None else own + got[0]

    def _sequence(self, items: list[Item], k: int, siblings: list[int], at: int, closed: bool, began: bool = False, pinned: bool = False):
        """(captures, place after the last, first place or -1) of items[k:] from a sibling on: greedy, with backtracking."""
        if k == len(items):
            return ([], at, -1) if not closed or not any(self.rows[s][0].named for s in siblings[at:]) else None
        item = items[k]
        limit = len(siblings)

        def rest(caps: list, end: int, first: int, more: bool):
            if more and item.quantifier in ("*", "+"):
                for s, one, e in places(end, True):
                    got = rest(caps + one, e, first, True)
                    if got is not None:
                        return got
            got = self._sequence(items, k + 1, siblings, end, closed, True, False)
            return None if got is None else (caps + got[0], got[1], first if first >= 0 else got[2])

        def places(start: int, again: bool):
            for s in range(start, limit):
                if item.shape == "group":
                    got = self._sequence(item.kids, 0, siblings, s, item.closed, pinned=True)
                    if got is not None:
                        yield s, [(c, siblings[s]) for c in item.captures] + got[0], max(got[1], s + 1)
                else:
                    one = self._one(item, siblings[s])
                    if one is not None:
                        yield s, one, s + 1
                if pinned or (item.anchored and not (began and not again and k == 0) or again and item.anchored) and self.rows[siblings[s]][0].named:
                    return

        if not (k == 0 and began and item.anchored):
            for s, one, e in places(at, False):
                got = rest(one, e, s, True)
                if got is not None:
                    return got
        if item.quantifier in ("?", "*"):
            return self._sequence(items, k + 1, siblings, at, closed, began, pinned)
        return None

    def tests(self, found: tuple) -> list[tuple] | None:
        """(question, its values: a node for its text, or a text) of each predicate that a match has to pass; None if it fails any text."""
        k, _, _, caps = found
        first: dict[str, int] = {}
        for name, pre in caps:
            first.setdefault(name, pre)
        out: list[tuple] = []
        for name, args in self.patterns[k].predicates:
            if name.endswith("!"):
                continue
            if name not in ARITY:
                if self.foreign == "deny":
                    return None
                continue
            values = [first.get(v) if kind == "capture" else v for kind, v in args]
            if values[0] is None or name in ("eq?", "not-eq?") and values[1] is None:
                continue
            no = name.startswith("not-")
            if "eq?" in name:
                out.append((str.__ne__ if no else str.__eq__, values))
            elif "any-of?" in name:
                of = frozenset(values[1:])
                out.append(((lambda x, of=of: x not in of) if no else of.__contains__, values[:1]))
            else:
                search = self._regex[args[1][1]].search
                out.append(((lambda x, search=search: search(x) is None) if no else (lambda x, search=search: search(x) is not None), values[:1]))
        return out
