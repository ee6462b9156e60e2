"""Scanner books, repair policies, resumed parses, unmerged tables and segment effects, against fresh or brute-force results."""

import json
import random

import pytest

from sylva.operators import segments, trees
from sylva.plans import effects, tables
from sylva.plans.parser import Parser, flat
from sylva.plans.scanner import BookError, Memory, Scanner, line_at, soak
from sylva.queries import UNMERGED
from sylva.sources import store
from sylva.streaming.edits import Session, amends

JSON, OUTLINE = store.builtin("json"), store.builtin("outline")
NAMES = {"open": 1, "close": 2, "body": 3, "one": 4, "two": 5}
ALL = frozenset(NAMES.values())


def book(*rules, **more):
    return Scanner({"rules": list(rules), **more}, NAMES)


def rule(when, then, name="r", phase="ordered", **more):
    return {"name": name, "phase": phase, "when": when, "then": then, **more}


def named(text):
    return trees.sexp(Parser.of(OUTLINE).parse(text).roots)


def item(*kids):
    return "(item label: (label)" + (f" items: (block {' '.join(kids)})" if kids else "") + ")"


def test_offside_book():
    assert named("a\n  b\n    c\n  d\ne") == f"(document {item(item(item()), item())} {item()})"
    assert named("a\n\n\tb\n \n  \tc\n") == f"(document {item(item(), item())})"  # a tab reaches column 8, as two blanks and a tab do
    assert named("a\r\n b\r\nc") == f"(document {item(item())} {item()})"
    assert named("") == "(document)"
    assert Parser.of(OUTLINE).parse("a\n    b\n  c\n").stop == "accepted"  # closed to a column that was never opened


def test_offside_against_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        depth, lines, want = 0, [], 0
        for _k in range(rng.randrange(1, 30)):
            lines.append("  " * depth + "x")
            step = rng.choice([-2, -1, 0, 1])
            new = max(0, depth + step)
            if step == 1:
                want += 1
            depth = new
        if depth and len(lines[-1]) - 1 < 2 * depth:
            want -= step == 1
        rows = flat(Parser.of(OUTLINE).parse("\n".join(lines)).roots)
        assert sum(r[0].kind == "item" for r in rows) == len(lines)
        assert sum(r[0].kind == "block" for r in rows) == want


def test_book_memory():
    heredoc = book(
        rule([["probe", "head"]], [["push", "marks", "doc", 0, ["group", 1]], ["emit", "open"]]),
        rule([["marks.depth", ">", 0], ["bol"], ["marks.top.tag"]], [["pop", "marks"], ["emit", "close", 3]], phase="inside"),
        rule([["marks.depth", ">", 0], ["probe", "line"]], [["emit", "body"]], phase="inside"),
        kinds={"doc": 1},
        probes={"head": "<<(\\w+)\\n", "line": "[^\\n]*\\n"},
    )
    m, at, got, text = Memory(), 0, [], "<<END\nx y\nEND"
    while answer := heredoc.ask(text, at, ALL, m):
        got.append(answer)
        at = answer.end
    assert got == [(1, 0, 6), (3, 6, 10), (2, 10, 13)] and m.marks == []
    nest = book(rule([["probe", "o"], ["nest", "o", "c"]], [["emit", "body"]]), probes={"o": "/\\*", "c": "\\*/"})
    assert nest.ask("/* a /* b */ c */ d", 0, ALL, Memory()) == (3, 0, 17)
    assert nest.ask("/* a", 0, ALL, Memory()) == (3, 0, 4)
    assert nest.ask("/**/", 0, frozenset([1]), Memory()) is None
    named = book(rule([["probe", "w"]], [["emit", "one", "classified", "words"]]), probes={"w": "[a-z]+"}, classes={"words": [["two", "two"], ["x.*", "body"]]})
    assert [named.ask(t, 0, ALL, Memory()).terminal for t in ("two", "xylo", "other")] == [5, 3, 4]
    assert named.ask("two", 0, frozenset([4]), Memory()) is None
    stops = book(rule([["probe", "w"]], [["abstain"]]), rule([], [["emit", "one", 0]]), probes={"w": "a"})
    assert stops.ask("a", 0, ALL, Memory()) is None and stops.ask("b", 0, ALL, Memory()) == (4, 0, 0)
    counts = book(rule([["probe", "n"], ["reg", 0, "<", ["number", 1]]], [["set", 0, ["+", ["reg", 0], ["span", 0]]], ["refuse"]]), rule([["reg", 0, ">=", 2]], [["emit", "two", ["max", 0, ["-", "frames.depth", 1]]]]), probes={"n": "(\\d+)"})
    m = Memory()
    assert counts.ask("12", 0, ALL, m) == (5, 0, 0) and m.registers[0] == 2


def test_book_passes_and_groups():
    quote = book(
        rule([["bol"], ["frames.depth", ">", 0], ["pass", 0, "=", "frames.depth"]], [["emit", "one", "pass.eaten"]], phase="enclosing"),
        rule([["bol"], ["frames.depth", ">", 0], ["no_fires", "mark"]], [["pop", "frames"], ["emit", "close", 0]], phase="enclosing"),
        rule([["probe", "gt"]], [], phase="matched", kind="quote"),
        rule([["probe", "gt"]], [["push", "frames", "lead", "quote"], ["emit", "open"]], groups=["mark"]),
        kinds={"quote": 1},
        probes={"gt": "> ?"},
    )
    m = Memory()
    assert quote.ask("> a", 0, ALL, m) == (1, 0, 2) and m.frames == [(0, "quote")]
    assert quote.ask("> a\n> b", 4, ALL, m) == (4, 4, 6)
    before = m.copy()
    assert quote.ask("> a\nb", 4, ALL, m) == (2, 4, 4) and m.frames == [] and before.stance() != m.stance()


@pytest.mark.parametrize("bad", [rule([["odd"]], []), rule([["probe", "none"]], []), rule([], [["emit", "nobody"]]), rule([["wanted", "nobody"]], []), rule([], [], phase="later"), rule([["lead", "~", 1]], []), rule([["frames.has", "none"]], []), rule([["fires", "none"]], []), rule([], [["jump"]]), rule([], [["set", 0, "odd"]])])
def test_bad_books(bad):
    with pytest.raises(BookError):
        book(bad)
    with pytest.raises(BookError):
        book(probes={"p": "("})


def test_lines_of_books():
    assert soak("  \tx", 0, 8) == (3, 8) and soak("    ", 0, 8, want=2) == (2, 2) and soak("  ", 0, 8, limit=1) == (1, 1)
    assert line_at("a\n \n  b", 4, 8) == (False, 2, False, True, 1) or line_at("a\n \n  b", 4, 8).lead == 2
    assert line_at("", 0, 8).blank and line_at("x", 0, 8).bol


def outcome(t):
    return t.stop, t.at, t.symbol, t.state, t.mends, t.skipped, t.supplied, t.spurned, t.scars, [(n.kind, n.start, n.end, d) for n, _, _, _, _, d, _ in flat(t.roots)]


@pytest.mark.parametrize("mend", ["none", "keep", "fell", "relent"])
def test_sessions_equal_fresh_parses(mend):
    p, rng, resumed = Parser.of(JSON), random.Random(5), 0
    for _ in range(25):
        s = Session(p, "[" + ",".join('{"k%d": [%d, null]}' % (i, i) for i in range(rng.randrange(1, 40))) + "]", mend)
        cold = Session(p, s.text, mend, reuse=False)
        for _k in range(4):
            a = rng.randrange(len(s.text) + 1)
            cut = (a, min(len(s.text), a + rng.randrange(3)), rng.choice(["", "1", ",", '"x"', "{", "}", " "]))
            s.amend(*cut)
            cold.amend(*cut)
            assert outcome(s.tree) == outcome(p.parse(s.text, mend)) == outcome(cold.tree)
            resumed += s.resumed > 0
            assert cold.resumed == 0
    assert resumed > 20
    with pytest.raises(ValueError):
        s.amend(0, 10_000_000, "")


def test_felled_and_relenting():
    p = Parser.of(JSON)
    kept, fell, relent = (p.parse("[1, ] ] ] ] 2, 3", m) for m in ("keep", "fell", "relent"))
    assert not any(s.felled for s in kept.scars)
    for t in (kept, fell, relent):
        spans = [(r.start, r.end) for r in t.roots]
        assert spans == sorted(spans) and "ERROR" not in trees.sexp(t.roots)
    felled = p.parse("[1 : 2]", "fell")
    assert [s.felled for s in felled.scars if s.gave is None][:1] == [True]
    assert [s.felled for s in p.parse("[1 : : 2]", "relent").scars if s.gave is None][:2] == [False, True]


def test_unmerged_tables():
    g = Parser.of(UNMERGED).grammar
    merged, used = tables.merged(g), tables.build(g)
    assert {(merged.grammar.symbol_name(f.terminal), f.harm) for f in tables.frayed(merged)} == {("d", "fold_dropped"), ("e", "fold_dropped")}
    assert merged.conflicts and not used.conflicts and len(merged.kernels) < len(used.kernels) <= tables.GROWTH * len(merged.kernels)
    for text, kind in (("acd", "x"), ("bcd", "y"), ("ace", "y"), ("bce", "x")):
        t = Parser.of(UNMERGED).parse(text)
        assert t.stop == "accepted" and f"({kind})" in trees.sexp(t.roots)
    assert tables.frayed(Parser.of(JSON).tables) == []


def real(text):
    moves, whole = effects.trail(Parser.of(JSON), text)
    assert whole
    return moves


def test_effects_compose():
    t, rng = Parser.of(JSON).tables, random.Random(1)
    moves = [e for m in real('[1, {"a": [true, null]}, "x", {}]') for e in m]
    whole = effects.fold(t, moves)
    assert whole.grounded and whole.entry == 0 and len(whole.push) == 1
    for _ in range(200):
        a, b = sorted(rng.sample(range(len(moves) + 1), 2))
        x, y, z = (effects.fold(t, part) for part in (moves[:a], moves[a:b], moves[b:]))
        assert effects.compose(t, effects.compose(t, x, y), z) == effects.compose(t, x, effects.compose(t, y, z)) == whole
    assert effects.compose(t, effects.IDENTITY, whole) == effects.compose(t, whole, effects.IDENTITY) == whole
    assert effects.compose(t, effects.HOLE, effects.IDENTITY) is None and effects.compose(t, whole, effects.HOLE) is None
    for _ in range(200):  # also where most are no neighbours
        x, y, z = (rng.choice(moves) for _k in range(3))
        assert effects.compose(t, effects.compose(t, x, y), z) == effects.compose(t, x, effects.compose(t, y, z))


def test_possible_effects_hold_the_real_ones():
    t = Parser.of(JSON).tables
    moves = real('{"a": [1, [2], {"b": null}]}')
    read = [m[-1].push[-1] for m in moves if m]
    for k in range(0, len(read) - 3):
        got = effects.fold(t, [e for m in moves[k : k + 3] for e in m])
        like = [p for p in effects.possible(t, read[k : k + 3]) if (p.entry, p.push, p.reaches) == (got.entry, got.push, got.reaches)]
        assert any(all(x == y and s <= r for (x, s), (y, r) in zip(got.guard, p.guard, strict=True)) for p in like)


def test_guards():
    a, b = ((1, frozenset([1, 2])),), ((1, frozenset([2, 3])), (4, frozenset([5])))
    assert effects.meet(a, b) == ((1, frozenset([2])), (4, frozenset([5]))) and effects.meet(a, ((2, frozenset([1])),)) is None
    assert effects.join(a, a[:1]) == a and effects.join(a, b) is None
    e = effects.Effect(3, a, (7,))
    assert e.shape == (1, (7,)) and effects.merged([e, effects.Effect(3, ((1, frozenset([9])),), (7,))])[0].guard[0][1] == {1, 2, 9}


def test_segments_and_survey(spark):
    docs = spark.createDataFrame([(1, "[1, [2, 3], {}]"), (2, "[1"), (3, None), (4, "[1 2]"), (5, "")], "doc_id long, text string")
    rows = segments.segments(docs, JSON, 3)
    got = {r["doc_id"]: r for r in segments.products(rows, JSON).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1]["grounded"] and got[1]["left"] == "document" and got[1]["segments"] > 3
    assert got[2]["left"] is None and got[4]["left"] is None and not got[4]["grounded"]
    survey = {r["size"]: r for r in segments.survey(docs, JSON, (2, 4)).collect()}
    assert survey[2]["segments"] > survey[4]["segments"] > 0 and survey[2]["domain"] <= survey[2]["segments"]
    assert segments.products(segments.segments(docs.where("false"), JSON), JSON).count() == 0


def test_amend_costs(spark):
    long = "[" + ",".join(str(k) for k in range(60)) + "]"
    rows = [(1, 0, 0, 0, long), (1, 1, len(long) - 1, len(long) - 1, ",7"), (1, 2, 9_999, 9_999, "x"), (2, 0, 0, 0, "é"), (2, 1, 1, 2, ""), (None, 0, 0, 0, "x")]
    got = {(r["doc_id"], r["seq"]): r for r in amends(spark.createDataFrame(rows, "doc_id long, seq long, from int, to int, insert string"), JSON).collect()}
    assert len(got) == 5 and got[1, 2]["refused"] and got[2, 1]["refused"] and got[1, 1]["resumed"] > 100
    assert got[1, 1]["stop_kind"] == "accepted" and got[1, 1]["kept"] >= 120 and got[1, 0]["resumed"] == 0


def test_books_travel_with_grammars():
    bare = {k: v for k, v in json.loads(OUTLINE).items() if k != "scanner"}
    again = store.with_scanner(json.dumps(bare), json.dumps(json.loads(OUTLINE)["scanner"]))
    assert trees.sexp(Parser.of(again).parse("a\n b").roots) == named("a\n b")
    assert Parser.of(json.dumps(bare)).parse("a\n").stop != "accepted"
