"""Effects of token segments as rows, their ordered products, and what segmentations of a corpus look like."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import effects as E
from ..plans.parser import Parser
from ..plans.shapes import Shape, Shapes
from .trees import grouped, shaped

SEGMENTS = "segment int, tokens int, entry int, reaches int, push string, guard string, hole boolean"
PRODUCTS = "segments int, entry int, reaches int, left string, grounded boolean"
#: Effects, or products, that a task keeps at once.
MOST_KNOWN = 50_000
#: Token counts of the segmentations that a survey compares.
SIZES = (4, 8, 16, 32, 128)


def _row(e: E.Effect) -> tuple:
    return e.entry, len(e.guard), json.dumps(list(e.push)), json.dumps([[x, sorted(s)] for x, s in e.guard]), e.hole


def _effect(entry, push: str, guard: str, hole: bool) -> E.Effect:
    return E.Effect(entry, tuple((x, frozenset(s)) for x, s in json.loads(guard)), tuple(json.loads(push)), hole)


def _cut(grammar: str, text: str, size: int) -> list[tuple]:
    p = Parser.of(grammar)
    moves, whole = E.trail(p, text)
    runs = [moves[k : k + size] for k in range(0, len(moves), size)]
    out = [(k, len(run), *_row(E.fold(p.tables, (e for m in run for e in m)))) for k, run in enumerate(runs)]
    return out if whole else [*out, (len(out), 0, *_row(E.HOLE))]


def _of_shape(grammar: str, texts: list[str], shape: Shape, at: tuple, make) -> Iterator[tuple[slice, object]]:
    """(texts, what ``make`` gives for them): once for a shape where one stack reads as the parser does, else text by text."""
    if shape.kept and Shapes.of(grammar).plain:
        if at not in shape.made:
            shape.made[at] = make(texts[0])
        yield slice(0, len(texts)), shape.made[at]
    else:
        for k, t in enumerate(texts):
            yield slice(k, k + 1), make(t)


def segments(docs: DataFrame, grammar: str, size: int = 32, **on) -> DataFrame:
    """The effect of every ``size`` tokens of each text. A text that a table refuses ends in a hole."""

    def columns(text: str) -> list[pa.Array]:
        types = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.bool_()]
        rows = _cut(grammar, text, size)
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

    def make(which, texts, shape, bounds):
        for of, got in _of_shape(grammar, texts, shape, ("segments", size), columns):
            n = len(got[0])
            again = pa.array(np.tile(np.arange(n), of.stop - of.start))
            yield np.repeat(which[of], n), [c.take(again) for c in got]

    return shaped(docs, grammar, make, SEGMENTS, **on)


def _product(p: Parser, rows: list[tuple]) -> tuple:
    """(segments, entry, reaches, left, grounded) of segments (entry, push, guard, hole) in order."""
    e = E.fold(p.tables, (_effect(*r) for r in rows))
    left = None if e is None else " ".join(p.grammar.symbol_name(s) for s in e.push)
    return len(rows), e and e.entry, None if e is None else e.reaches, left, e is not None and e.grounded


_PRODUCT = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]


def products(rows: DataFrame, grammar: str, key: str = "doc_id") -> DataFrame:
    """(key, segments, entry, reaches, left, grounded) of each text: the product of its segments in order, nulls for none.

    A key's segments meet in one shuffle; equal sequences of segments are composed once a task.
    """
    p = Parser.of(grammar)
    names = ["segment", "entry", "push", "guard", "hole"]
    out = T.StructType([rows.schema[key], *T.StructType.fromDDL(PRODUCTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            got = []
            for cell in b.column(1):
                of = tuple((r["entry"], r["push"], r["guard"], r["hole"]) for r in cell.as_py())
                if of not in known:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    known[of] = _product(p, list(of))
                got.append(known[of])
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate(_PRODUCT)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], out.names)

    held = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__s"))
    return held.mapInArrow(run, out)


def folded(docs: DataFrame, grammar: str, size: int = 32, **on) -> DataFrame:
    """``products`` of the ``segments`` of each text, composed where the text was read: nothing is shuffled."""
    p = Parser.of(grammar)

    def whole(text: str) -> tuple:
        return _product(p, [(r[2], r[4], r[5], r[6]) for r in _cut(grammar, text, size)])

    def make(which, texts, shape, bounds):
        for of, got in _of_shape(grammar, texts, shape, ("folded", size), whole):
            yield which[of], [pa.array([v] * (of.stop - of.start), t) for v, t in zip(got, _PRODUCT, strict=True)]

    return shaped(docs, grammar, make, PRODUCTS, **on)


def survey(docs: DataFrame, grammar: str, sizes: tuple[int, ...] = SIZES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each segmentation: segments, distinct effects, distinct shapes, distinct entries, the deepest reach and its 90 % quantile.

    A text is read once for all sizes; tasks count equal effects, so that effects are shuffled and not segments.
    """
    names = ["size", "entry", "reaches", "push", "guard", "n"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]

    def counted(t: str) -> Counter:
        return Counter((size, r[2], r[3], r[4], r[5]) for size in sizes for r in _cut(grammar, t, size) if not r[6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def ready() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in total.items()]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for b in batches:
            for _, texts, shape, _ in grouped(grammar, b.column(0)):
                for of, got in _of_shape(grammar, texts, shape, ("survey", sizes), counted):
                    for k, n in got.items():
                        total[k] += n * (of.stop - of.start)
                if len(total) >= MOST_KNOWN:
                    yield ready()
        yield ready()

    seen = docs.select(text).mapInArrow(run, "size int, entry int, reaches int, push string, guard string, n long")
    seen = seen.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
    counts = seen.groupBy("size").agg(
        F.sum("n").alias("segments"),
        F.count(F.lit(1)).alias("effects"),
        F.countDistinct("reaches", "push").alias("shapes"),
        F.countDistinct("entry").alias("domain"),
        F.max("reaches").alias("deepest"),
    )
    reach = seen.groupBy("size", "reaches").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy("size").orderBy("reaches"))
    usual = reach.withColumns({"__b": below, "__t": F.sum("n").over(Window.partitionBy("size"))}).where("10 * __b >= 9 * __t").groupBy("size").agg(F.min("reaches").alias("usual"))
    counts = counts.join(usual, "size")
    asked = docs.sparkSession.createDataFrame([(s,) for s in sizes], "size int")
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("segments", "effects", "shapes", "domain")]
    return asked.join(counts, "size", "left").select("size", *none, "deepest", "usual")
