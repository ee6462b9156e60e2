"""Grammars as data: rules in JSON become symbols and flat productions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from . import regex


class GrammarError(ValueError):
    """A grammar that can't be compiled; the message names the rule."""


@dataclass(frozen=True)
class Terminal:
    name: str
    kind: str  # literal, regex or external
    body: str
    shape: str  # named, anonymous, hidden
    prec: int = 0
    immediate: bool = False


@dataclass(frozen=True)
class Step:
    symbol: int
    prec: int | str = 0
    assoc: str = ""
    alias: tuple[str, bool] | None = None
    field: str | None = None


@dataclass(frozen=True)
class Production:
    lhs: int
    steps: tuple[Step, ...]
    dynamic: int = 0


@dataclass
class Grammar:
    name: str
    terminals: list[Terminal] = field(default_factory=list)
    nonterminals: list[tuple[str, str]] = field(default_factory=list)  # (name, shape)
    productions: list[Production] = field(default_factory=list)
    extras: set[int] = field(default_factory=set)
    supertypes: list[str] = field(default_factory=list)
    conflicts: list[frozenset[str]] = field(default_factory=list)
    precedences: list[list] = field(default_factory=list)
    word: int | None = None

    def is_terminal(self, s: int) -> bool:
        return s < len(self.terminals)

    def symbol_name(self, s: int) -> str:
        return self.terminals[s].name if self.is_terminal(s) else self.nonterminals[s - len(self.terminals)][0]

    def shape(self, s: int) -> str:
        return self.terminals[s].shape if self.is_terminal(s) else self.nonterminals[s - len(self.terminals)][1]

    @cached_property
    def size(self) -> int:
        return len(self.terminals) + len(self.nonterminals)

    @cached_property
    def by_lhs(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for k, p in enumerate(self.productions):
            out.setdefault(p.lhs, []).append(k)
        return out

    @cached_property
    def nullable(self) -> set[int]:
        out: set[int] = set()
        while more := {p.lhs for p in self.productions if p.lhs not in out and all(s.symbol in out for s in p.steps)}:
            out |= more
        return out

    @cached_property
    def first(self) -> dict[int, set[int]]:
        """Terminals that may begin each symbol."""
        out = {s: {s} if self.is_terminal(s) else set() for s in range(self.size)}
        changed = True
        while changed:
            changed = False
            for p in self.productions:
                for s in p.steps:
                    if not out[s.symbol] <= out[p.lhs]:
                        out[p.lhs] |= out[s.symbol]
                        changed = True
                    if s.symbol not in self.nullable:
                        break
        return out

    @cached_property
    def barren(self) -> set[str]:
        """Nonterminals that derive no string."""
        good = set(range(len(self.terminals)))
        while more := {p.lhs for p in self.productions if p.lhs not in good and all(s.symbol in good for s in p.steps)}:
            good |= more
        return {self.symbol_name(s) for s in range(self.size) if s not in good}

    @cached_property
    def kinds(self) -> set[str]:
        """Named kinds that trees may show."""
        own = {self.symbol_name(s) for s in range(self.size) if self.shape(s) == "named"}
        return own | {s.alias[0] for p in self.productions for s in p.steps if s.alias and s.alias[1]}

    @cached_property
    def literals(self) -> set[str]:
        own = {t.name for t in self.terminals if t.shape == "anonymous"}
        return own | {s.alias[0] for p in self.productions for s in p.steps if s.alias and not s.alias[1]}

    @cached_property
    def fields(self) -> set[str]:
        return {s.field for p in self.productions for s in p.steps if s.field}

    @cached_property
    def members(self) -> dict[str, set[str]]:
        """Of each supertype, the visible kinds that it stands for, through hidden rules."""
        names = {self.symbol_name(s): s for s in range(self.size)}

        def reach(s: int, seen: set[int]) -> set[str]:
            out: set[str] = set()
            for k in self.by_lhs.get(s, ()):
                for step in self.productions[k].steps:
                    if step.alias and step.alias[1]:
                        out.add(step.alias[0])
                    elif self.shape(step.symbol) == "named":
                        out.add(self.symbol_name(step.symbol))
                    elif step.symbol not in seen and not self.is_terminal(step.symbol):
                        out |= reach(step.symbol, seen | {step.symbol})
            return out

        return {name: reach(names[name], set()) for name in self.supertypes if name in names}


def _token_tree(rule: dict, rules: dict):
    """The regular expression of a rule that is one token."""
    kind = rule.get("type")
    if kind == "STRING":
        return regex.literal(rule["value"])
    if kind == "PATTERN":
        return regex.parse(rule["value"])
    if kind == "BLANK":
        return ("cat", [])
    if kind in ("SEQ", "CHOICE"):
        return ("cat" if kind == "SEQ" else "alt", [_token_tree(m, rules) for m in rule["members"]])
    if kind in ("REPEAT", "REPEAT1"):
        return ("rep", _token_tree(rule["content"], rules), int(kind == "REPEAT1"), None)
    if kind == "SYMBOL" and rule["name"] in rules:
        return _token_tree(rules[rule["name"]], rules)
    if "content" in rule:
        return _token_tree(rule["content"], rules)
    raise GrammarError(f"{kind} inside a token")


def load(source: str | dict) -> tuple[Grammar, list]:
    """(grammar, regular expression of each terminal) from a JSON grammar.

    Rules that are one token become terminals; the others productions, repetitions left-recursive auxiliaries. The
    first rule is the start, production 0 its augmentation. ``inline`` rules are expanded where they stand.
    """
    data = json.loads(source) if isinstance(source, str) else source
    try:
        name, rules = data["name"], data["rules"]
    except (KeyError, TypeError) as e:
        raise GrammarError("a grammar has a name and rules") from e
    if not rules:
        raise GrammarError("a grammar has rules")
    externals = {x["name"] for x in data.get("externals", ()) if x.get("type") == "SYMBOL"}
    inline, supertypes = set(data.get("inline", ())), list(data.get("supertypes", ()))
    tokens: dict[Terminal, object] = {}

    def bare(rule: dict) -> tuple[dict, int, bool]:
        """(content, lexical precedence, immediate) beneath token wrappers."""
        prec, immediate = 0, False
        while rule["type"] in ("TOKEN", "IMMEDIATE_TOKEN", "PREC", "PREC_LEFT", "PREC_RIGHT", "PREC_DYNAMIC"):
            immediate |= rule["type"] == "IMMEDIATE_TOKEN"
            if rule["type"].startswith("PREC") and isinstance(rule.get("value"), int):
                prec = rule["value"]
            rule = rule["content"]
        return rule, prec, immediate

    def terminal(rule: dict, label: str | None = None) -> Terminal:
        inner, prec, immediate = bare(rule)
        kind = "literal" if inner["type"] == "STRING" else "regex"
        body = inner["value"] if "value" in inner and isinstance(inner["value"], str) else json.dumps(inner, sort_keys=True)
        shape = "anonymous" if label is None else "hidden" if label.startswith("_") else "named"
        t = Terminal(label or (body if kind == "literal" else body), kind, body, shape if label or kind == "literal" else "hidden", prec, immediate)
        tokens.setdefault(t, _token_tree(inner, rules))
        return t

    def is_token(rule: dict) -> bool:
        return rule["type"] in ("STRING", "PATTERN", "TOKEN", "IMMEDIATE_TOKEN") or rule["type"].startswith("PREC") and rule["type"] != "PREC_DYNAMIC" and rule["content"]["type"] in ("STRING", "PATTERN", "TOKEN", "IMMEDIATE_TOKEN")

    start = next(iter(rules))
    named_tokens = {k: terminal(r, k) for k, r in rules.items() if k != start and is_token(r)}
    for x in externals:
        t = Terminal(x, "external", x, "hidden" if x.startswith("_") else "named")
        tokens.setdefault(t, None)
        named_tokens.setdefault(x, t)
    # Sequences hold (key, attributes); keys are ('t', Terminal) or ('n', name).
    made: dict[str, list] = {}
    auxiliary: dict[str, str] = {}

    def alts(rule: dict, owner: str, path: tuple = ()) -> list[tuple[list, int]]:
        """Alternatives of (steps, dynamic precedence)."""
        kind = rule.get("type")
        if kind == "BLANK":
            return [([], 0)]
        if kind == "SYMBOL":
            ref = rule["name"]
            if ref in named_tokens:
                return [([(("t", named_tokens[ref]), {})], 0)]
            if ref not in rules:
                raise GrammarError(f"rule {owner!r} names {ref!r}, which is no rule")
            if ref in inline and ref not in path:
                return alts(rules[ref], owner, (*path, ref))
            return [([(("n", ref), {})], 0)]
        if kind in ("STRING", "PATTERN", "TOKEN", "IMMEDIATE_TOKEN"):
            return [([(("t", terminal(rule)), {})], 0)]
        if kind == "CHOICE":
            return [a for m in rule["members"] for a in alts(m, owner, path)]
        if kind == "SEQ":
            out: list[tuple[list, int]] = [([], 0)]
            for m in rule["members"]:
                out = [(a + b, x if abs(x) >= abs(y) else y) for a, x in out for b, y in alts(m, owner, path)]
            return out
        if kind in ("REPEAT", "REPEAT1"):
            body = json.dumps(rule["content"], sort_keys=True)
            if body not in auxiliary:
                aux = auxiliary[body] = f"{owner}_repeat{len(auxiliary) + 1}"
                inner = [a for a in alts(rule["content"], owner, path) if a[0]]
                made[aux] = inner + [([(("n", aux), {})] + a, d) for a, d in inner]
            one = [([(("n", auxiliary[body]), {})], 0)]
            return one if kind == "REPEAT1" else [*one, ([], 0)]
        if kind in ("ALIAS", "FIELD"):
            out = []
            for steps, dynamic in alts(rule["content"], owner, path):
                extra = {"alias": (rule["value"], bool(rule.get("named")))} if kind == "ALIAS" else {"field": rule["name"]}
                out.append(([(k, extra | a if kind == "FIELD" else a | extra) for k, a in steps], dynamic))
            return out
        if kind == "RESERVED":
            return alts(rule["content"], owner, path)
        if kind == "PREC_DYNAMIC":
            return [(s, rule["value"] if abs(rule["value"]) > abs(d) else d) for s, d in alts(rule["content"], owner, path)]
        if kind in ("PREC", "PREC_LEFT", "PREC_RIGHT"):
            mark = {"prec": rule.get("value", 0), "assoc": {"PREC_LEFT": "left", "PREC_RIGHT": "right"}.get(kind, "")}
            return [([(k, mark | a) for k, a in s], d) for s, d in alts(rule["content"], owner, path)]
        raise GrammarError(f"rule {owner!r} has an unknown type {kind!r}")

    for k, r in rules.items():
        if k not in named_tokens and k not in inline:
            made[k] = alts(r, k)
    extras = []
    for x in data.get("extras", [{"type": "PATTERN", "value": "\\s"}]):
        extras.append(("t", named_tokens[x["name"]]) if x["type"] == "SYMBOL" and x["name"] in named_tokens else ("n", x["name"]) if x["type"] == "SYMBOL" else ("t", terminal(x)))
    end = Terminal("end", "external", "", "hidden")
    g = Grammar(name, [end, *tokens], supertypes=supertypes, conflicts=[frozenset(c) for c in data.get("conflicts", ())], precedences=data.get("precedences", []))
    shape = lambda k: "hidden" if k.startswith("_") or k in supertypes or k in auxiliary.values() else "named"
    order = [start, *[k for k in made if k != start]]
    g.nonterminals = [("start", "hidden"), *[(k, shape(k)) for k in order]]
    number = {("t", t): k for k, t in enumerate(g.terminals)} | {("n", k): len(g.terminals) + 1 + j for j, k in enumerate(order)}
    g.productions.append(Production(len(g.terminals), (Step(number["n", start]),)))
    seen = set()
    for k in order:
        for steps, dynamic in made[k]:
            p = Production(number["n", k], tuple(Step(number[key], a.get("prec", 0), a.get("assoc", ""), a.get("alias"), a.get("field")) for key, a in steps), dynamic)
            if p not in seen:
                seen.add(p)
                g.productions.append(p)
    g.extras = {number[x] for x in extras if x in number}
    if data.get("word") in named_tokens:
        g.word = number["t", named_tokens[data["word"]]]
    return g, [None, *tokens.values()]
