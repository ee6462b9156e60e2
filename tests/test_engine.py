"""Grammar, tables, parser, patterns and their DataFrame operators on small cases with expected results by hand."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sylva.functions import lines
from sylva.operators import fold, navigate, report, trees
from sylva.plans import grammar, pattern, regex, tables
from sylva.plans.parser import Parser, flat
from sylva.sources import store
from sylva.streaming import edits

JSON = store.builtin("json")


def rule(kind, **more):
    return {"type": kind, **more}


def sym(name):
    return rule("SYMBOL", name=name)


def lit(value):
    return rule("STRING", value=value)


def seq(*members):
    return rule("SEQ", members=list(members))


def choice(*members):
    return rule("CHOICE", members=list(members))


def shape(text, source=JSON, everything=False, mend="fell"):
    return trees.sexp(Parser.of(source).parse(text, mend).roots, everything)


@pytest.mark.parametrize("p, t, end", [("a|ab", "abc", 2), ("a?(ab)?", "ab", 2), ("[^x]+", "abx", 2), (r"\d{2,3}", "12345", 3), ("é+", "éé", 2), ("(ab)*", "ababa", 4), ("[a-c]{2}", "abc", 2), (r"\u{61}b", "ab", 2), ("x", "y", 0)])
def test_longest_match(p, t, end):
    a = regex.Automaton([regex.parse(p)])
    assert a.longest(t, 0, frozenset([0]))[0] == end


@pytest.mark.parametrize("p", ["(", "[a", "a)", "*", "[b-a]", "(?=a)", "a\\"])
def test_bad_patterns(p):
    with pytest.raises(regex.RegexError):
        regex.parse(p)


def test_automaton_against_re():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice(["a", "b", "[ab]", "a*", "b+", "(ab)?", "a{2}"]) for _ in range(4))
        t = "".join(rng.choice("ab") for _ in range(8))
        want = max((k for k in range(len(t) + 1) if re.fullmatch(p, t[:k])), default=0)
        assert regex.Automaton([regex.parse(p)]).longest(t, 0, frozenset([0]))[0] == want, (p, t)


def test_json_trees():
    assert shape('{"k": [1, null]}') == "(document (object (pair key: (string (string_content)) value: (array (number) (null)))))"
    assert shape('// hi\n[ "a\\n" ] ') == "(document (comment) (array (string (string_content) (escape_sequence))))"
    assert shape("[]", everything=True) == '(document (array "[" "]"))'
    assert shape("") == "(document)" and shape("  ") == "(document)"
    root = Parser.of(JSON).parse(" [1] ").roots[0]
    assert (root.start, root.end) == (1, 5)


def test_stops_and_mends():
    p = Parser.of(JSON)
    for mend, kind in (("none", "unexpected"), ("keep", "unexpected"), ("fell", "unexpected")):
        assert p.parse('{"a" 1}', mend).stop == kind
    t = p.parse('{"a" 1}')
    assert (t.supplied, t.mends, t.at, t.scars[0].gave) == (1, 0, 5, ":")
    t = p.parse("[1 2]", "keep")
    assert (t.mends, t.skipped, len(t.scars)) == (1, 1, 1) and t.skipped == sum(s.over - s.at for s in t.scars)
    assert p.parse("[1", "none").stop == "truncated" and p.parse("[1", "none").roots
    with pytest.raises(ValueError):
        p.parse("1", "other")
    for _ in range(200):
        text = "".join(random.Random(_).choice('[]{},:"1a \\n') for _k in range(30))
        t = p.parse(text)
        assert len(t.scars) == t.mends + t.supplied
        for n, pre, parent, *_rest in flat(t.roots):
            assert 0 <= n.start <= n.end <= len(text)


def test_precedence_alias_inline_hidden():
    e = sym("e")
    binary = lambda op, prec: rule("PREC_LEFT", value=prec, content=seq(rule("FIELD", name="left", content=e), lit(op), rule("FIELD", name="right", content=e)))
    source = {"name": "sum", "rules": {"top": e, "e": choice(binary("+", 1), binary("*", 2), rule("ALIAS", value="literal", named=True, content=sym("num")), sym("_group")), "_group": seq(lit("("), e, lit(")")), "num": rule("PATTERN", value="[0-9]+")}}
    import json

    text = json.dumps(source)
    assert shape("1+2*3", text) == "(top (e left: (e (literal)) right: (e left: (e (literal)) right: (e (literal)))))"
    assert shape("1+2+3", text) == "(top (e left: (e left: (e (literal)) right: (e (literal))) right: (e (literal))))"
    assert shape("(1)", text, True) == '(top (e "(" (e (literal)) ")"))'
    t = Parser.of(text).tables
    assert {c.verdict for c in t.conflicts} == {"precedence", "associativity"}
    assert tables.quotient(t) <= len(t.kernels) and sum(map(len, tables.classes(t))) == len(t.grammar.terminals)


def test_declared_conflicts_fork():
    import json

    source = {"name": "amb", "rules": {"s": choice(seq(sym("a"), lit("x")), seq(sym("b"), lit("y"))), "a": sym("w"), "b": sym("w"), "w": rule("PATTERN", value="[a-z]")}, "conflicts": [["a", "b"]]}
    assert shape("qx", json.dumps(source)) == "(s (a (w)))" and shape("qy", json.dumps(source)) == "(s (b (w)))"
    dynamic = {"name": "dyn", "rules": {"s": choice(sym("a"), sym("b")), "a": seq(sym("w")), "b": rule("PREC_DYNAMIC", value=5, content=sym("w")), "w": lit("q")}, "conflicts": [["a", "b"]]}
    assert shape("q", json.dumps(dynamic)) == "(s (b (w)))"


def test_grammar_errors_and_facts():
    for bad in ("{}", '{"name": "x", "rules": {}}', '{"name": "x", "rules": {"a": {"type": "SYMBOL", "name": "nope"}}}', '{"name": "x", "rules": {"a": {"type": "WHAT"}}}'):
        with pytest.raises(grammar.GrammarError):
            grammar.load(bad)
    g, _ = grammar.load(JSON)
    assert g.members["_value"] == {"object", "array", "string", "number", "true", "false", "null"} and not g.barren
    loop, _ = grammar.load({"name": "x", "rules": {"a": choice(lit("q"), sym("b")), "b": seq(sym("b"), lit("z"))}})
    assert loop.barren == {"b"}


def found(scm, text, source=JSON, **more):
    p = Parser.of(source)
    rows = flat(p.parse(text).roots)
    got = pattern.Matcher(pattern.compile_(scm, p.grammar), p.grammar, **more).matches(rows, text)
    return [(k, [(c, text[rows[n][0].start : rows[n][0].end]) for c, n in caps]) for k, _, _, caps in got]


def test_patterns():
    text = '{"a": 1, "b": [2, "x", 3, null]}'
    assert found("(number) @n", text) == [(0, [("n", "1")]), (0, [("n", "2")]), (0, [("n", "3")])]
    assert found("(array (number) @x (number) @y)", text) == [(0, [("x", "2"), ("y", "3")])]
    assert found("(array (number) @x . (number) @y)", text) == []
    assert found("(array . (_) @f)", text) == [(0, [("f", "2")])] and found("(array (_) @l .)", text) == [(0, [("l", "null")])]
    assert found('(array "," @c)', text) == [(0, [("c", ",")])] * 3
    assert found("(pair key: (string) @k value: [(number) (array)] @v)", text)[0] == (0, [("k", '"a"'), ("v", "1")])
    assert found("(array (number)+ @n)", text) == [(0, [("n", "2"), ("n", "3")])]
    assert found("(_value/number) @n (_value) @v", '[1]') == [(1, [("v", "[1]")]), (0, [("n", "1")]), (1, [("v", "1")])]
    assert found("(object !key) @o", text) == [(0, [("o", text)])]
    assert found('((number) @n (#eq? @n "2"))', text) == [(0, [("n", "2")])]
    for predicate, want in (('#eq? @n "2"', ["2"]), ('#not-eq? @n "2"', ["1", "3"]), ('#any-of? @n "1" "3"', ["1", "3"]), ('#not-any-of? @n "1" "3"', ["2"]), ('#match? @n "[12]"', ["1", "2"]), ('#not-match? @n "[12]"', ["3"])):
        assert [c[0][1] for _, c in found(f"((number) @n ({predicate}))", text)] == want
    assert found('(pair value: (number)? @n) @p (pair) @q', '{"a": "s"}') == [(0, [("p", '"a": "s"')]), (1, [("q", '"a": "s"')])]
    assert found("(array (object) @a (object) @b)", "[{},{},{},{},{}]") == [(0, [("a", "{}"), ("b", "{}")])] * 2


@pytest.mark.parametrize("scm, word", [("(nope)", "nope"), ("(pair nope: (_))", "nope"), ('"nope"', "nope"), ("(nope/number)", "nope"), ("((number) @a (#eq? @b \"1\"))", "b"), ("(number", ""), ("(number)*", ""), ("[]", ""), ('"a', ""), ("(#eq? @a @b)", ""), ('((number) @a (#match? @a "("))', "("), ("((number) @a (#eq? @a))", "eq?")])
def test_pattern_errors(scm, word):
    with pytest.raises(pattern.PatternError) as e:
        pattern.compile_(scm, Parser.of(JSON).grammar)
    assert e.value.word == word


def test_dead_patterns_and_foreign_predicates():
    g = Parser.of(JSON).grammar
    causes = [p.dead for p in pattern.compile_("(array key: (string)) (object (number)) (_value/pair) (array (number))", g)]
    assert causes == ["field_not_carried", "child_not_admitted", "not_a_member", None]
    scm = "((number) @n (#odd? @n) (#set! x y))".replace("((number) @n", "(array (number) @n")
    with pytest.raises(pattern.PatternError):
        found(scm, "[1]")
    assert len(found(scm, "[1]", foreign="admit")) == 1 and found(scm, "[1]", foreign="deny") == []


@pytest.fixture(scope="module")
def nodes(spark):
    docs = spark.createDataFrame([(1, '{"é": [1, 22], "b": {}}'), (2, "[[[]]] 7"), (3, None), (4, "[1,,")], "doc_id long, text string")
    return trees.nodes(docs, JSON).cache()


def test_navigation(nodes, spark):
    rows = {(r["doc_id"], r["ref"]): r for r in nodes.collect()}
    assert {d for d, _ in rows} == {1, 2, 4}
    n = next(r for r in rows.values() if r["doc_id"] == 1 and r["kind"] == "number")
    assert (n["start"], n["end"]) == (8, 9)  # bytes
    sizes = {(r["doc_id"], r["ref"]): r["size"] for r in navigate.sizes(nodes).collect()}
    above = {}
    for (d, k), r in rows.items():
        p, count = r["parent"], 0
        while p is not None:
            above[d, p] = above.get((d, p), 0) + 1
            count += 1
            p = rows[d, p]["parent"]
        assert r["depth"] == count
    assert all(s == 1 + above.get(k, 0) for k, s in sizes.items())
    pairs = navigate.ancestors(nodes, nodes.select("doc_id", "ref")).groupBy("doc_id", "ancestor").count().collect()
    assert {(r["doc_id"], r["ancestor"]): r["count"] for r in pairs} == above
    for r in navigate.sheet(nodes).collect():
        run = sorted((x for x in rows.values() if x["doc_id"] == r["doc_id"] and x["parent"] == r["parent"]), key=lambda x: x["ord"])
        later = [x["ref"] for x in run if x["ord"] > r["ord"]]
        assert r["next"] == (later[0] if later else None)
        assert r["next_named"] == next((x["ref"] for x in run if x["ord"] > r["ord"] and x["named"]), None)
        assert r["prev_named"] == next((x["ref"] for x in run[::-1] if x["ord"] < r["ord"] and x["named"]), None)
        kids = sorted((x for x in rows.values() if x["doc_id"] == r["doc_id"] and x["parent"] == r["ref"]), key=lambda x: x["ord"])
        assert (r["first_child"], r["last_child"]) == ((kids[0]["ref"], kids[-1]["ref"]) if kids else (None, None))
    ask = spark.createDataFrame([(1, 8, 9), (1, 8, 12), (1, 0, 99), (2, 2, 2)], "doc_id long, from int, to int")
    got = {(r["doc_id"], r["from"], r["to"]): r["ref"] and rows[r["doc_id"], r["ref"]]["kind"] for r in navigate.covering(nodes, ask).collect()}
    assert got[1, 8, 9] == "number" and got[1, 8, 12] == "array" and got[1, 0, 99] is None
    both = spark.createDataFrame([(1, n["ref"], n["ref"] + 2)], "doc_id long, a int, b int")
    assert rows[1, navigate.lowest_common(nodes, both).head()["lca"]]["kind"] == "array"
    assert navigate.by_field(nodes, "value").where("doc_id = 1").count() == 2
    assert navigate.roots(nodes).where("doc_id = 1").count() == 1 and navigate.children(nodes).count() == len(rows) - navigate.roots(nodes).count()


def test_survey_and_words(nodes, spark):
    s = navigate.survey(nodes).agg(F.sum("loose"), F.sum("disorder"), F.sum("torn")).head()
    assert tuple(s) == (0, 0, 0)
    bad = spark.createDataFrame([(1, 0, None, 0, 0, 5), (1, 1, 0, 0, 3, 4), (1, 2, 0, 1, 2, 9), (1, 2, 0, 1, 2, 9), (1, 3, 8, 0, 0, 1)], "doc_id long, ref int, parent int, ord int, start int, end int")
    r = navigate.survey(bad).head()
    assert (r["loose"], r["torn"]) == (2, 3) and r["disorder"] >= 1
    words = navigate.parens(nodes)
    for d in (1, 2):
        word = "".join("(" if r["open"] else ")" for r in words.where(f"doc_id = {d}").orderBy("k").collect())
        assert word.count("(") * 2 == len(word) and fold_word(word) == (0, 0)
    e = fold.balanced(fold.excess(words.withColumn("step", F.when(F.col("open"), 1).otherwise(-1)), run=3))
    assert e.where("balanced").count() == 3


def fold_word(word):
    total = low = 0
    for c in word:
        total += 1 if c == "(" else -1
        low = min(low, total)
    return total, low


def test_excess_is_a_homomorphism(spark):
    rng = random.Random(3)
    words = {k: [rng.choice([1, -1]) for _ in range(rng.randrange(1, 40))] for k in range(20)}
    df = spark.createDataFrame([(d, k, s) for d, w in words.items() for k, s in enumerate(w)], "doc_id long, k int, step int")
    for run in (1, 4, 512):
        for r in fold.excess(df, run=run).collect():
            sums = [sum(words[r["doc_id"]][:k]) for k in range(len(words[r["doc_id"]]) + 1)]
            assert (r["total"], r["low"], r["high"]) == (sums[-1], min(sums), max(sums))
    text = fold.ordered(df, F.col("k").cast("string"), F.lit(""), lambda a, b: F.concat(a, b), run=3)
    assert all(r["product"] == "".join(map(str, range(len(words[r["doc_id"]])))) for r in text.collect())


def test_places_and_touched(spark):
    leaves = spark.createDataFrame([(1, k, 4) for k in range(5)], "doc_id long, k int, bytes int")
    placed = fold.places(leaves)
    assert [r["offset"] for r in placed.orderBy("k").collect()] == [0, 4, 8, 12, 16]
    touch = lambda a, b: [r["k"] for r in fold.touched(placed, spark.createDataFrame([(1, a, b)], "doc_id long, from int, to int")).orderBy("k").collect()]
    assert touch(4, 4) == [] and touch(5, 5) == [1] and touch(3, 9) == [0, 1, 2]


def test_lines(spark):
    text = "a\n \t# n\n\n\té\n// x\n/* y\n  "
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n")], "doc_id long, text string")
    rows = lines.lines(df).where("doc_id = 1").orderBy("line_no").collect()
    assert [r["start"] for r in rows] == [0, 2, 8, 9, 13, 18, 23] and [r["column"] for r in rows] == [0, 8, 0, 8, 0, 0, 2]
    assert [r["shape_hash"] for r in rows] == ["code", "note", "blank", "code", "code", "rough", "rough"]
    assert rows[4]["shape_slashes"] == "note"
    assert {d: lines.lines(df).where(f"doc_id = {d}").count() for d in (2, 3, 4)} == {2: 1, 3: 0, 4: 2}
    one = df.where("doc_id = 1").select(lines.find(F.col("text"), "é\n", F.lit(2)).alias("f"), lines.past(F.col("text"), " \t", F.lit(2)).alias("p"), lines.seek(F.col("text"), "//", F.lit(0)).alias("s"), lines.where(F.col("text"), F.lit(8)).alias("w")).head()
    assert (one["f"], one["p"], one["s"], tuple(one["w"])) == (7, 4, text.index("//"), (3, 1))


def test_edits(spark):
    assert edits.script("3..5=a\\nb") == (3, 5, "a\nb")
    with pytest.raises(ValueError):
        edits.script("5..3=a")
    rows = [(1, 1, 0, 0, '{"a": 1}'), (1, 2, 6, 7, "[é]"), (1, 4, 8, 8, "x"), (1, 3, 99, 100, "no"), (2, 1, 0, 0, "1")]
    df = spark.createDataFrame(rows, "doc_id long, seq long, from int, to int, insert string")
    got = {r["doc_id"]: (r["text"], r["edits"]) for r in edits.replay(df).collect()}
    assert got == {1: ('{"a": [é]}', 2), 2: ("1", 1)}


def test_live_edits(spark, tmp_path):
    rows = [(1, 1, 0, 0, '{"a": 1}'), (1, 2, 6, 7, "[2]"), (2, 1, 0, 0, "[1]"), (1, 3, 50, 60, "x")]
    spark.createDataFrame(rows, "doc_id long, seq long, from int, to int, insert string").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("doc_id long, seq long, from int, to int, insert string").parquet(f"{tmp_path}/in")
    q = edits.live(stream, JSON).writeStream.format("memory").queryName("costs").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["doc_id"], r["seq"]): r for r in spark.sql("select * from costs").collect()}
    assert len(got) == 4 and got[1, 3]["refused"] and got[1, 2]["bytes"] == 10 and got[1, 2]["kept"] > 0
    assert all(r["nodes"] == r["kept"] + r["minted"] and r["stop_kind"] == "accepted" for r in got.values())


def test_store(spark, tmp_path):
    seal = store.save(spark, JSON, str(tmp_path))
    store.save(spark, store.builtin("markup"), str(tmp_path))
    assert store.load(spark, str(tmp_path), "json") == JSON and len(seal) == 64
    with pytest.raises(store.StoreError):
        store.load(spark, str(tmp_path), "other")
    frames = store.frames(spark, JSON)
    frames["actions"].limit(3).write.mode("overwrite").parquet(f"{tmp_path}/language=json/actions")
    with pytest.raises(store.StoreError):
        store.load(spark, str(tmp_path), "json")
    (tmp_path / "a.txt").write_text("x\ny")
    assert store.texts(spark, f"{tmp_path}/a.txt").head()["text"] == "x\ny"


def test_reports(spark):
    rows = [(1, '{"a": 1, "b": [2]}'), (2, "[]"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: json.loads(r["json"]) for r in report.matches_json(df, JSON, "(number) @n (array) @a").collect()}
    spans = lambda k: sorted((m["pattern"], c["name"], c["start"], c["end"]) for m in got[k]["matches"] for c in m["captures"])
    assert spans(1) == [(0, "n", 6, 7), (0, "n", 15, 16), (1, "a", 14, 17)] and spans(2) == [(1, "a", 0, 2)]
    assert got[1]["patterns"] == 2 and set(got) == {1, 2}
    stops = {r["doc_id"]: json.loads(r["json"])["stop"]["kind"] for r in report.parses_json(df, JSON).collect()}
    assert stops == {1: "accepted", 2: "accepted"}
    texts = ["a\tb\n`\\", "é" * 19 + "xyé", "é" * 19 + "xyz", "x" * 41, "\x01", "", None]
    shown = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(report.excerpt(F.col("t"))).collect()]
    assert shown == ["a\\tb\\n\\`\\\\", "é" * 19 + "xy...", "é" * 19 + "xy...", "x" * 40 + "...", "\\x01", "", None]
    state = report.state(spark, JSON, 0).collect()
    assert {r["part"] for r in state} >= {"item", "shift"}
    with pytest.raises(ValueError):
        report.state(spark, JSON, 10_000)
    held = report.holding(spark, JSON, "-> object .").collect()
    assert held and all(r["item"].endswith("-> object .") for r in held)
    assert report.holding(spark, JSON, held[0]["item"]).count() >= 1


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
