"""Texts of one shape are parsed once, and give the rows that a parse of each gives; node columns equal joins and windows over node rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.operators import fold, navigate, segments, trees
from sylva.plans.parser import Parser, flat
from sylva.plans.shapes import Shapes
from sylva.queries import JSON, MARKUP, OUTLINE, PAIRS

ODD = ["", "  ", '{"a" : [1, 2.5e3, -0, true,null ] } // c\n', '{"é一😀":"x\\n\\u00e9y"}', "[1 2]", '{"a":}', '"abc', '{"a":01}', "/* x */ [ ]", "1 2 3", "tru", ' "a  b" ', '"//"', '{"a":"b",}']


def order(rng, k):
    return '{"o":%d,"s":"%s","l":[%s]}' % (k, rng.choice("OFP"), ",".join('{"n":%d,"p":%d}' % (j, rng.randint(1, 20000)) for j in range(rng.randint(0, 5))))


def texts(n=400):
    rng = random.Random(5)
    noise = ["".join(rng.choice('{}[]",:0123.e-\\u tfn/*é\n') for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [order(rng, k) for k in range(n)] + ODD * 2 + noise


def pages(n=400):
    rng = random.Random(6)
    return ["".join(rng.choice(["<p>", "</p>", '<a href="x">', "text ", "é", "<br/>", "<!-- c -->", "<script>", "</script>", "x<y", " "]) for _ in range(rng.randint(0, 5))) for _ in range(n)]


@pytest.mark.parametrize("source, given", [(JSON, texts()), (MARKUP, pages()), (OUTLINE, ["a\n  b\nc", "", "x\n y\n  z\n q", "a\n  b\nc"])])
def test_shapes_equal_parses(source, given):
    shapes, p, seen = Shapes(Parser.of(source)), Parser.of(source), Counter()
    for _ in range(2):
        for which, shape, bounds in shapes.read(given):
            for i, at in zip(which.tolist(), bounds.tolist(), strict=True):
                seen[i] += 1
                want = [(*(getattr(r[0], k) for k in ("kind", "under", "field", "named", "extra", "start", "end")), *r[1:]) for r in flat(p.parse(given[i]).roots)]
                got = [(*(getattr(r[0], k) for k in ("kind", "under", "field", "named", "extra")), at[s], at[e], *r[1:]) for r, s, e in zip(shape.rows, shape.start, shape.end, strict=True)]
                assert got == want, given[i]
    assert seen == Counter({i: 2 for i in range(len(given))})


def test_a_shape_is_parsed_once(monkeypatch):
    rng, calls, parse = random.Random(1), [], Parser.parse
    monkeypatch.setattr(Parser, "parse", lambda self, *a, **k: calls.append(1) or parse(self, *a, **k))
    shapes = Shapes(Parser.of(JSON))
    got = list(shapes.read([order(rng, k) for k in range(2000)]))
    assert sum(len(w) for w, _, _ in got) == 2000 and len(calls) < 100


def test_bounds_of_what_is_kept(monkeypatch):
    monkeypatch.setattr("sylva.plans.shapes.MOST_ROWS", 60)
    rng = random.Random(1)
    given = [order(rng, k) for k in range(100)]
    assert sorted(i for w, _, _ in Shapes(Parser.of(JSON)).read(given) for i in w.tolist()) == list(range(100))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate([*texts(60), None])), "doc_id long, text string").cache()


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_columns_equal_joins_and_windows(docs):
    all_ = trees.nodes(docs, JSON).cache()
    got = trees.nodes(docs, JSON, columns=("ref", "parent_kind", "next", "prev", "next_named", "prev_named")).cache()
    assert rows(got.select("doc_id", "ref", "parent_kind")) == rows(navigate.parent(all_).select("doc_id", "ref", "parent_kind"))
    assert rows(got.drop("parent_kind")) == rows(navigate.siblings(all_).select("doc_id", "ref", "next", "prev", "next_named", "prev_named"))
    first = trees.nodes(docs, JSON, columns=("parent", "ref", "field", "of_field")).where("of_field and field = 'value'")
    assert rows(first.select("doc_id", "parent", "ref")) == rows(navigate.by_field(all_, "value"))
    at = docs.withColumns({"from": F.lit(5), "to": F.lit(6)})
    kinds = navigate.covering(all_, at.select("doc_id", "from", "to")).where("ref is not null").join(all_.select("doc_id", "ref", "kind"), ["doc_id", "ref"])
    assert rows(trees.covering(at, JSON).where("ref is not null")) == rows(kinds.select("doc_id", "ref", "kind"))
    words = navigate.parens(all_).withColumn("step", F.when(F.col("open"), 1).otherwise(-1))
    assert rows(trees.excess(docs, JSON)) == rows(fold.excess(words, run=8))


def test_survey_equals_windows(docs):
    def change(ids, kinds, start, end):
        return start, end + 9 * ((ids % 3 == 0)[:, None] & (kinds == "pair")), 1 + ((ids % 2 == 0)[:, None] & np.isin(kinds, ["number", "array"]))

    n = trees.nodes(docs, JSON, columns=("ref", "parent", "ord", "kind", "start", "end"))
    n = n.withColumn("end", F.when((F.col("kind") == "pair") & (F.col("doc_id") % 3 == 0), F.col("end") + 9).otherwise(F.col("end")))
    n = n.withColumn("x", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind").isin("number", "array") & (F.col("doc_id") % 2 == 0), 2).otherwise(1))))
    assert rows(trees.survey(docs, JSON, change).where("nodes > 0")) == rows(navigate.survey(n))


def test_matches_equal_matches_text_by_text(docs):
    from sylva.plans.pattern import Matcher, compile_

    p = Parser.of(JSON)
    for scm in (PAIRS, '(pair key: (string (string_content) @k) value: (_) @v (#not-eq? @k "n"))', '((number) @n (#match? @n "^1"))', "(array (_) @a (_) @b)", '(pair key: (string (string_content) @k) (#any-of? @k "o" "s")) (object) @x'):
        m, want, tally = Matcher(compile_(scm, p.grammar), p.grammar), [], Counter()
        for k, t in docs.where("text is not null").collect():
            tree = flat(p.parse(t).roots)
            place = lambda x, t=t: len(t[:x].encode())
            for i, (pat, finish, opened, caps) in enumerate(m.matches(tree, t)):
                tally[k] += 1
                want += [(k, i, pat, place(finish), place(opened), j, n, at, place(tree[at][0].start), place(tree[at][0].end), t[tree[at][0].start : tree[at][0].end]) for j, (n, at) in enumerate(caps)]
        assert rows(trees.captures(docs, JSON, scm)) == sorted(map(repr, want))
        assert rows(trees.matches(docs, JSON, scm, columns=("match",)).groupBy("doc_id").count()) == sorted(map(repr, tally.items()))


def test_folded_equals_products(docs):
    assert rows(segments.folded(docs, JSON, 3)) == rows(segments.products(segments.segments(docs, JSON, 3), JSON))


def test_survey_of_segments_reads_once(spark, docs):
    from pyspark.sql.functions import percentile_approx

    got = {r["size"]: tuple(r) for r in segments.survey(docs, JSON, (2, 8)).collect()}
    for size in (2, 8):
        s = segments.segments(docs, JSON, size).where("not hole")
        want = s.agg(F.lit(size), F.count(F.lit(1)), F.countDistinct("entry", "push", "guard"), F.countDistinct("reaches", "push"), F.countDistinct("entry"), F.max("reaches"), percentile_approx("reaches", 0.9, 10_000)).head()
        assert got[size] == tuple(want)
    assert [tuple(r) for r in segments.survey(docs.where("false"), JSON, (4,)).collect()] == [(4, 0, 0, 0, 0, None, None)]


def test_node_rows_are_not_broadcast(docs):
    n = trees.nodes(docs, JSON)
    at = docs.select("doc_id", F.lit(5).alias("from"), F.lit(6).alias("to"))
    for df in (navigate.parent(n), navigate.survey(n), navigate.ancestors(n, n.select("doc_id", "ref"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    hit = navigate.covering(n, at)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in hit


def test_scanners_look_at_lines_only_when_asked(monkeypatch):
    from sylva.plans import scanner

    calls, real = [], scanner.line_at
    monkeypatch.setattr(scanner, "line_at", lambda *a: calls.append(1) or real(*a))
    text = "c\n" + "  o\n    l\n" * 20
    rows_ = flat(Parser.of(OUTLINE).parse(text).roots)
    assert sum(r[0].kind == "item" for r in rows_) == 41 and len(calls) <= 4 * 41


def test_edit_costs_need_no_call_a_key(spark):
    from sylva.streaming.edits import amends

    e = spark.createDataFrame([(1, 1, 1, 1, '"a":1'), (1, 0, 0, 0, "{}"), (2, 0, 0, 0, "[]"), (None, 0, 0, 0, "x")], 'doc_id long, seq int, `from` int, `to` int, insert string')
    got = amends(e, JSON)
    assert rows(got.select("doc_id", "seq", "bytes", "stop_kind")) == rows(spark.createDataFrame([(1, 0, 2, "accepted"), (1, 1, 7, "accepted"), (2, 0, 2, "accepted")], "a long, b long, c int, d string"))
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
