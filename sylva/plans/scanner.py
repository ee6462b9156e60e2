"""Scanners as data: rules of a JSON book answer for the terminals that no pattern can spell.

A rule is a list of tests and a list of actions. Tests read the text, the line, the terminals that the parser's state
permits, and a bounded memory: frames (width, kind), marks (kind, count, tag) and registers. Actions answer with a
terminal or change the memory. The book is compiled to closures once a process; a text's memory is a small value, so a
scanner can be stopped anywhere and resumed from a copy.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

# Fixed values of the book format.
PHASES = ("inside", "layout", "commanded", "opening", "enclosing", "bounded", "ordered")
CALLED = "matched"
FRAMES, MARKS, TAG_BYTES, REGISTERS, TAB = 96, 64, 192, 8, 8
#: How deep rules that ask about other rules may nest.
NESTED = 2

Value = Callable[["Ask"], int]
Test = Callable[["Ask"], bool]


class BookError(ValueError):
    """A book that can't be compiled; the message names the rule and the word."""


@dataclass
class Memory:
    frames: list[tuple[int, str]] = field(default_factory=list)
    marks: list[tuple[str, int, str]] = field(default_factory=list)
    registers: list[int] = field(default_factory=lambda: [0] * REGISTERS)
    since: int = 0

    def copy(self) -> Memory:
        return Memory(list(self.frames), list(self.marks), list(self.registers), self.since)

    def stance(self) -> tuple:
        """A value that is equal for equal memories."""
        return tuple(self.frames), tuple(self.marks), tuple(self.registers)


class Answer(NamedTuple):
    terminal: int
    start: int
    end: int


class Line(NamedTuple):
    bol: bool
    lead: int
    blank: bool
    lull: bool
    column: int


def soak(text: str, at: int, tab: int, column: int = 0, limit: int | None = None, want: int | None = None) -> tuple[int, int]:
    """(place, column) after the blanks at a place, up to a number of them or to a column."""
    last = len(text) if limit is None else min(len(text), at + limit)
    while at < last and text[at] in " \t" and (want is None or column < want):
        column += tab - column % tab if text[at] == "\t" else 1
        at += 1
    return at, column


def line_at(text: str, at: int, tab: int) -> Line:
    head = text.rfind("\n", 0, at) + 1
    tail = text.find("\n", at)
    inner, lead = soak(text, head, tab)
    before = text[text.rfind("\n", 0, head - 1) + 1 : head - 1] if head else "x"
    return Line(at == head, lead, inner >= (len(text) if tail < 0 else tail), not before.strip(" \t"), at - head)


class Ask:
    """One question at one place, and what the tests of the rule at hand have bound."""

    __slots__ = ("text", "at", "tab", "_line", "_lead0", "broke", "wanted", "fresh", "memory", "deep", "eaten", "lead", "match", "ran", "cursor")

    def __init__(self, text, at, tab, lead, wanted, fresh, memory, broke=False, deep=0):
        self.text, self.at, self.tab, self._line, self._lead0, self.broke = text, at, tab, None, lead, broke
        self.wanted, self.fresh, self.memory, self.deep = wanted, fresh, memory, deep
        self.begin()

    def begin(self, cursor: int = 0) -> Ask:
        self.eaten, self.lead, self.match, self.ran, self.cursor = None, None, None, {}, cursor
        return self

    @property
    def line(self) -> Line:
        """The line of the place, looked at when a test needs it."""
        if self._line is None:
            self._line = line_at(self.text, self.at, self.tab)
        return self._line

    @property
    def lead0(self) -> int:
        if self._lead0 is None:
            self._lead0 = self.line.lead
        return self._lead0

    @property
    def here(self) -> int:
        return self.at + (self.eaten or 0)

    def group(self, k: int) -> str:
        return (self.match.group(k) or "") if self.match and k <= self.match.re.groups else ""


@dataclass
class Rule:
    name: str
    phase: str
    kind: str | None
    closes: str | None
    groups: tuple[str, ...]
    tests: list[tuple[str, Test]]
    actions: list[Callable]
    #: Terminals that the rule may answer with; none for a rule of effects only.
    answers: frozenset[int]


_COMPARE: dict[str, Callable[[int, int], bool]] = {"=": int.__eq__, "!=": int.__ne__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}
_FACTS: dict[str, Test] = {
    "bol": lambda a: not a.at or a.text[a.at - 1] == "\n",
    "blank": lambda a: a.line.blank,
    "lull": lambda a: a.line.lull,
    "broke": lambda a: a.broke,
    "eof": lambda a: a.at >= len(a.text),
    "fresh": lambda a: a.fresh,
}
_READ: dict[str, Value] = {
    "lead": lambda a: a.lead0 if a.lead is None else a.lead,
    "column": lambda a: a.line.column,
    "width": lambda a: a.eaten or 0,
    "cursor": lambda a: a.cursor,
    "frames.depth": lambda a: len(a.memory.frames),
    "marks.depth": lambda a: len(a.memory.marks),
    "frames.top.width": lambda a: a.memory.frames[-1][0] if a.memory.frames else 0,
    "marks.top.count": lambda a: a.memory.marks[-1][1] if a.memory.marks else 0,
}
_PASSED = ("ran", "cursor", "budget", "eaten", "at", "more")
_JOIN: dict[str, Callable[[int, int], int]] = {"+": int.__add__, "-": int.__sub__, "max": max, "min": min}


class Scanner:
    def __init__(self, book: dict, terminals: dict[str, int]):
        self.terminals, self.tab = terminals, int(book.get("tab", TAB))
        self.kinds, self.opaque = set(book.get("kinds", ())), self._opaque(book)
        self.budget = int(book["budget"]) if "budget" in book else None
        try:
            self.probes = {k: re.compile(p) for k, p in book.get("probes", {}).items()}
            self.classes = {k: [(re.compile(p), self._terminal(k, t)) for p, t in arms] for k, arms in book.get("classes", {}).items()}
        except re.error as e:
            raise BookError(f"a probe of the book is no pattern: {e}") from e
        self.trivia = self._probe("trivia", book["trivia"]) if "trivia" in book else None
        known = {g for r in book.get("rules", ()) for g in r.get("groups", ())}
        self.rules = [self._rule(r, known) for r in book.get("rules", ())]
        self.by_phase = {p: [r for r in self.rules if r.phase == p] for p in (*PHASES, CALLED)}
        self._asked: dict[frozenset[int], list[tuple[str, list[Rule]]]] = {}
        for x in book.get("cohort", ()):
            self._terminal("cohort", x)

    @staticmethod
    def _opaque(book: dict) -> set[str]:
        numbers = {v: k for k, v in book["kinds"].items() if isinstance(v, int)} if isinstance(book.get("kinds"), dict) else {}
        return {numbers.get(x, x) for x in book.get("opaque", ())}

    # compiling

    def _terminal(self, where: str, name: str) -> int:
        if name not in self.terminals:
            raise BookError(f"rule {where!r} names {name!r}, which is no terminal of the grammar")
        return self.terminals[name]

    def _probe(self, where: str, name: str) -> re.Pattern:
        if name not in self.probes:
            raise BookError(f"rule {where!r} names {name!r}, which is no probe")
        return self.probes[name]

    def _of_kinds(self, where: str, names) -> frozenset[str]:
        out = frozenset([names] if isinstance(names, str) else names)
        if out - self.kinds:
            raise BookError(f"rule {where!r} names {min(out - self.kinds)!r}, which is no kind")
        return out

    def value(self, where: str, x) -> Value:
        if isinstance(x, int):
            return lambda a: x
        op, *rest = [x] if isinstance(x, str) else x
        if op in _READ:
            return _READ[op]
        if op.startswith("pass.") and op[5:] in _PASSED:
            return lambda a, k=op[5:]: a.ran.get(k, 0)
        if op == "reg":
            return lambda a, k=int(rest[0]): a.memory.registers[k]
        if op == "span":
            return lambda a, k=int(rest[0]): len(a.group(k))
        if op == "number":
            return lambda a, k=int(rest[0]): int(a.group(k)) if a.group(k).isdecimal() else 0
        if op == "frames.at.width":
            at = self.value(where, rest[0])
            return lambda a: a.memory.frames[at(a)][0] if 0 <= at(a) < len(a.memory.frames) else 0
        if op in _JOIN:
            left, right = (self.value(where, r) for r in rest)
            return lambda a, j=_JOIN[op]: j(left(a), right(a))
        raise BookError(f"rule {where!r} has an unknown value {op!r}")

    def _compared(self, where: str, left: Value, rest: list) -> Test:
        if len(rest) != 2 or rest[0] not in _COMPARE:
            raise BookError(f"rule {where!r} compares by {rest[:1]}")
        compare, right = _COMPARE[rest[0]], self.value(where, rest[1])
        return lambda a: compare(left(a), right(a))

    def test(self, where: str, x: list, groups: set[str]) -> Test:
        op, *rest = x
        plain = op.removeprefix("not_")
        if plain in _FACTS:
            fact = _FACTS[plain]
            return fact if plain == op else lambda a: not fact(a)
        if plain in ("wanted", "named"):
            t, yes = self._terminal(where, rest[0]), plain == op
            return lambda a: (t in a.wanted) == yes
        if op == "sole":
            t = self._terminal(where, rest[0])
            return lambda a: a.wanted == {t}
        if op == "probe":
            return self._probing(self._probe(where, rest[0]))
        if op == "no_probe":
            p = self._probe(where, rest[0])
            return lambda a: p.match(a.text, a.here) is None
        if op == "nest":
            return self._nesting(*(self._probe(where, r) for r in rest))
        if op == "soak":
            return self._soaking(where, rest)
        if op == "pass":
            return self._passing(where, rest)
        if op in ("fires", "no_fires"):
            return self._firing(where, op == "fires", rest, groups)
        if op in _READ:
            top = {"frames.top.width": "frames", "marks.top.count": "marks"}.get(op)
            held = self._compared(where, _READ[op], rest)
            return held if top is None else lambda a: bool(getattr(a.memory, top)) and held(a)
        if op == "reg":
            return self._compared(where, self.value(where, ["reg", rest[0]]), rest[1:])
        if op == "frames.at.width":
            at, held = self.value(where, rest[0]), self._compared(where, self.value(where, ["frames.at.width", rest[0]]), rest[1:])
            return lambda a: 0 <= at(a) < len(a.memory.frames) and held(a)
        if op == "frames.at.kind":
            at, of = self.value(where, rest[0]), self._of_kinds(where, rest[-1])
            return lambda a: 0 <= at(a) < len(a.memory.frames) and a.memory.frames[at(a)][1] in of
        if op == "frames.top.kind":
            of = self._of_kinds(where, rest[-1])
            return lambda a: bool(a.memory.frames) and a.memory.frames[-1][1] in of
        if op == "marks.top.kind":
            of = self._of_kinds(where, rest[-1])
            return lambda a: bool(a.memory.marks) and a.memory.marks[-1][0] in of
        if op == "frames.has":
            of = self._of_kinds(where, rest[-1])
            return lambda a: any(k in of for _, k in a.memory.frames)
        if op == "marks.has":
            of = self._of_kinds(where, rest[-1])
            return lambda a: any(m[0] in of for m in a.memory.marks)
        if op in ("marks.top.tag", "marks.has.tag"):
            return self._tagged(op == "marks.top.tag", rest)
        raise BookError(f"rule {where!r} has an unknown test {op!r}")

    @staticmethod
    def _probing(p: re.Pattern) -> Test:
        def run(a: Ask) -> bool:
            m = p.match(a.text, a.here)
            if m is None:
                return False
            a.match = a.match or m
            a.eaten = m.end() - a.at
            return True

        return run

    @staticmethod
    def _nesting(opens: re.Pattern, shuts: re.Pattern) -> Test:
        """To the end of a balanced run whose first opener is already read, or of the text."""

        def run(a: Ask) -> bool:
            at, depth = a.here, 1
            while at < len(a.text) and depth:
                if m := shuts.match(a.text, at):
                    depth -= 1
                elif m := opens.match(a.text, at):
                    depth += 1
                at = at + 1 if m is None or m.end() == at and depth else m.end()
            a.eaten = at - a.at
            return True

        return run

    def _soaking(self, where: str, rest: list) -> Test:
        want = self.value(where, rest[rest.index("to") + 1]) if "to" in rest else None
        begin = self.value(where, rest[rest.index("from") + 1]) if "from" in rest else None
        limit = 1 if "one" in rest else None

        def run(a: Ask) -> bool:
            column = begin(a) if begin else a.lead if a.lead is not None else self._carried(a.memory) if self.budget is not None else a.lead0
            at, a.lead = soak(a.text, a.here, self.tab, column, limit, want(a) if want else None)
            a.eaten = at - a.at
            return True

        return run

    def _passing(self, where: str, rest: list) -> Test:
        begin, more = self.value(where, rest[0]), list(rest[1:])
        after = "after" in more
        until = self.value(where, more[more.index("until") + 1]) if "until" in more else None
        compare = next(((k, self.value(where, more[j + 1])) for j, k in enumerate(more) if isinstance(k, str) and k in _COMPARE), None)

        def run(a: Ask) -> bool:
            at, lead = soak(a.text, a.here, self.tab) if after else (a.at, None)
            a.ran = self._pass(a, at, max(begin(a), 0), lead, max(until(a), 0) if until else None)
            return compare is None or _COMPARE[compare[0]](a.ran["ran"], compare[1](a))

        return run

    def _firing(self, where: str, yes: bool, rest: list, groups: set[str]) -> Test:
        group, after = rest[0], "after" in rest
        if group not in groups:
            raise BookError(f"rule {where!r} names {group!r}, which is no group")
        places = [self.value(where, v) for v in rest[rest.index("from") + 1 :]] if "from" in rest else None

        def run(a: Ask) -> bool:
            at, lead = (max(min(places[0](a), len(a.text)), 0), max(places[1](a), 0)) if places else soak(a.text, a.here if after else a.at, self.tab)
            return self._fires(a, group, at, lead) == yes

        return run

    @staticmethod
    def _tagged(top: bool, rest: list) -> Test:
        fold = str.lower if "folded" in rest else str
        k = int(rest[rest.index("group") + 1]) if "group" in rest else None

        def run(a: Ask) -> bool:
            same = (lambda tag: fold(a.group(k)) == fold(tag)) if k is not None else (lambda tag: fold(a.text[a.at : a.at + len(tag)]) == fold(tag))
            return any(same(m[2]) for m in (a.memory.marks[-1:] if top else a.memory.marks))

        return run

    def action(self, where: str, x: list) -> tuple[Callable, set[int]]:
        """(effect on (ask, answer so far), terminals it may answer with)"""
        op, *rest = x
        if op == "emit":
            arms = None
            if rest[1:2] == ["classified"]:
                if rest[2] not in self.classes:
                    raise BookError(f"rule {where!r} names {rest[2]!r}, which is no class")
                arms = self.classes[rest[2]]
            t, width = self._terminal(where, rest[0]), self.value(where, rest[1]) if len(rest) > 1 and arms is None else _READ["width"]

            def emit(a: Ask, out: dict) -> None:
                end = a.at + max(width(a), 0)
                out["terminal"], out["end"], out["start"] = t if arms is None else self._named(a, arms, t), end, out.get("skip", 0)

            return emit, {t} | {n for _, n in arms or ()}
        if op == "skip":
            by = self.value(where, rest[0])
            return lambda a, out: out.update(skip=out.get("skip", 0) + max(by(a), 0)), set()
        if op == "set":
            k, v = int(rest[0]), self.value(where, rest[1])
            return lambda a, out: a.memory.registers.__setitem__(k, max(v(a), 0)), set()
        if op == "pop":
            of = self._of_kinds(where, rest[-1]) if len(rest) > 1 else None

            def pop(a: Ask, out: dict) -> None:
                stack, at = (a.memory.frames, 1) if rest[0] == "frames" else (a.memory.marks, 0)
                while of and stack and stack[-1][at] not in of:
                    stack.pop()
                if stack:
                    stack.pop()

            return pop, set()
        if op == "push":
            return self._pushing(where, rest), set()
        if op in ("refuse", "abstain"):
            return lambda a, out: out.update(stop=op), set()
        raise BookError(f"rule {where!r} has an unknown action {op!r}")

    def _pushing(self, where: str, rest: list) -> Callable:
        if rest[0] == "frames":
            width, kind = self.value(where, rest[1]), min(self._of_kinds(where, rest[2]))
            return lambda a, out: a.memory.frames.append((max(width(a), 0), kind)) if len(a.memory.frames) < FRAMES else None
        kind, count = min(self._of_kinds(where, rest[1])), self.value(where, rest[2]) if len(rest) > 2 else lambda a: 0
        tag = rest[3] if len(rest) > 3 else ""

        def push(a: Ask, out: dict) -> None:
            text = a.group(0) if tag == "match" else a.group(int(tag[1])) if isinstance(tag, list) and tag[0] == "group" else tag[1] if isinstance(tag, list) else tag
            if len(a.memory.marks) < MARKS:
                a.memory.marks.append((kind, max(count(a), 0), text[:TAG_BYTES]))

        return push

    @staticmethod
    def _named(a: Ask, arms: list, otherwise: int) -> int:
        got = a.text[a.at : a.here]
        return next((t for p, t in arms if p.fullmatch(got)), otherwise)

    def _rule(self, r: dict, groups: set[str]) -> Rule:
        name, phase = r.get("name", "?"), r.get("phase")
        if phase not in PHASES and phase != CALLED:
            raise BookError(f"rule {name!r} has an unknown phase {phase!r}")
        tests = [(t[0], self.test(name, t, groups)) for t in r.get("when", ())]
        actions = [self.action(name, x) for x in r.get("then", ())]
        for key in ("kind", "closes"):
            if key in r:
                self._of_kinds(name, r[key])
        return Rule(name, phase, r.get("kind"), r.get("closes"), tuple(r.get("groups", ())), tests, [f for f, _ in actions], frozenset().union(*(t for _, t in actions)))

    # asking

    def _carried(self, memory: Memory) -> int:
        return memory.registers[self.budget] if self.budget is not None else 0

    def ask(self, text: str, at: int, wanted: frozenset[int], memory: Memory, fresh: bool = True, spent: frozenset[int] = frozenset()) -> Answer | None:
        """The first answer of the phases in their order. ``spent`` are terminals that have answered here without width."""
        phases = self._asked.get(wanted)
        if phases is None:  # rules that can answer here, or have effects only
            some = {p: [r for r in self.by_phase[p] if not r.answers or r.answers & wanted] for p in PHASES}
            phases = self._asked[wanted] = [(p, rules) for p, rules in some.items() if rules]
        if not phases:
            return None
        begin = at
        if self.trivia and (m := self.trivia.match(text, at)):
            at = m.end()
        broke = self.trivia is not None and any(c in "\r\n" for c in text[min(memory.since, begin) : at])
        sealed = memory.frames[-1][1] if memory.frames and memory.frames[-1][1] in self.opaque else None
        plain = Ask(text, at, self.tab, None, wanted, fresh, memory, broke)
        for phase, rules in phases:
            if phase == "layout" and not fresh:
                continue
            a = plain
            if phase == "layout":
                a = Ask(text, at, self.tab, None, wanted, fresh, memory, broke)
                a.at, a._lead0 = soak(text, at, self.tab, self._carried(memory))
            for r in rules:
                if r.answers and r.answers <= spent or phase == "layout" and sealed and r.closes != sealed:
                    continue
                if not self._holds(r, a):
                    continue
                out: dict = {}
                if not self._apply(r, a, out):
                    return None
                if "terminal" in out:
                    end = max(out["end"], a.at) + out.get("skip", 0)
                    if end > a.at + out.get("skip", 0):
                        memory.since = end
                    return Answer(out["terminal"], min(a.at + out["start"], end), end)
        return None

    @staticmethod
    def _holds(r: Rule, a: Ask, cursor: int = 0, skip: tuple = ()) -> bool:
        a.begin(cursor)
        for op, t in r.tests:
            if op not in skip and not t(a):
                return False
        return True

    def _apply(self, r: Rule, a: Ask, out: dict) -> bool:
        """Run a rule's actions; False if they end the whole question."""
        if r.answers and len(r.answers) > 1:  # a classified answer counts by the name that it takes
            trial: dict = {}
            held, a.memory = a.memory, a.memory.copy()
            for act in r.actions:
                act(a, trial)
            a.memory = held
            if "terminal" in trial and trial["terminal"] not in a.wanted:
                return True
        for act in r.actions:
            act(a, out)
            if "stop" in out:
                out.pop("terminal", None)
                break
        return out.get("stop") != "abstain"

    def _pass(self, a: Ask, at: int, cursor: int, lead: int | None, until: int | None) -> dict[str, int]:
        """Match the open frames from a cursor outwards, each by the rules of its kind, on a copy of the memory."""
        depth = len(a.memory.frames)
        if a.deep >= NESTED:
            return {"ran": 0, "cursor": cursor, "budget": 0, "eaten": 0, "at": at, "more": int(cursor < depth)}
        memory, begin, ran = a.memory.copy(), at, 0
        if lead is not None and self.budget is not None:
            memory.registers[self.budget] = lead
        while cursor < (depth if until is None else min(until, depth)):
            inner = Ask(a.text, at, self.tab, self._carried(memory), a.wanted, a.fresh, memory, a.broke, a.deep + 1)
            r = next((r for r in self.by_phase[CALLED] if r.kind == memory.frames[cursor][1] and self._holds(r, inner, cursor)), None)
            if r is None:
                break
            self._apply(r, inner, {})
            at, ran, cursor = inner.here, ran + 1, cursor + 1
        return {"ran": ran, "cursor": cursor, "budget": self._carried(memory), "eaten": at - begin, "at": at, "more": int(cursor < depth)}

    def _fires(self, a: Ask, group: str, at: int, lead: int) -> bool:
        """Whether some rule of a group would hold at a place; nothing is changed."""
        if a.deep >= NESTED:
            return False
        inner = Ask(a.text, at, self.tab, lead, a.wanted, a.fresh, a.memory.copy(), a.broke, a.deep + 1)
        return any(self._holds(r, inner, skip=("fires", "no_fires")) for r in self.rules if group in r.groups)
