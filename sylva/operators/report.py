"""Reports for programs and readers: JSON objects of matches and parses, excerpts of captures, states of compiled grammars."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parser import Parser
from ..plans.pattern import compile_
from ..sources import store
from . import trees

#: Bytes of a capture that an excerpt shows.
SHOWN = 40


def excerpt(text: Column, shown: int = SHOWN) -> Column:
    """The whole characters of a text's first ``shown`` bytes on one line, with escapes, and ``...`` where more follows."""
    raw = text.cast("binary")
    head = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, shown - k).cast("string")) for k in range(4)])
    out = F.replace(head, F.lit("\\"), F.lit("\\\\"))
    for plain, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("`", "\\`")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    hexed = out
    for code in range(32):
        hexed = F.replace(hexed, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    out = F.when(out.rlike(r"[\x00-\x1f]"), hexed).otherwise(out)
    return F.concat(out, F.when(F.octet_length(text) > F.octet_length(head), "...").otherwise(""))


def matches_json(docs: DataFrame, grammar: str, patterns: str, foreign: str = "refuse", mend: str = "fell", **on) -> DataFrame:
    """(key, json): one object a text, its matches in the order of output with the names and spans of their captures.

    Texts without a match have an empty list; null texts give no row. One parse a text, and nothing is shuffled.
    """
    g = Parser.of(grammar).grammar
    lazy, name, many = trees._Lazy(grammar, patterns, foreign), g.name, len(compile_(patterns, g))

    def make(which, texts, shape, bounds):
        m = trees._Matches.of(lazy, shape)
        named = m.name.to_pylist()
        spans = [[(named[j], shape.start[m.ref[j]], shape.end[m.ref[j]]) for j in range(f, f + n)] for f, n in zip(m.first.tolist(), m.n.tolist(), strict=True)]
        out = []
        for held, at in zip(m.held(texts, bounds).tolist(), trees._in_bytes(texts, bounds).tolist(), strict=True):
            found = [{"pattern": k, "captures": [{"name": n, "start": at[s], "end": at[e]} for n, s, e in caps]} for k, caps, yes in zip(m.pattern.tolist(), spans, held, strict=True) if yes]
            out.append(json.dumps({"language": name, "patterns": many, "matches": found}, ensure_ascii=False, separators=(",", ":")))
        yield which, [out]

    return trees.shaped(docs, grammar, make, "json string", mend, **on)


def parses_json(docs: DataFrame, grammar: str, mend: str = "fell", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, json): one object a text, how its parse stopped and what repair did."""
    stop = F.struct(F.col("stop_kind").alias("kind"), F.when(F.col("stop_kind") == "unexpected", F.col("stop_symbol")).alias("symbol"), F.when(F.col("stop_kind").isin("stray", "unexpected"), F.col("stop_at")).alias("at"), F.when(F.col("stop_kind") == "unexpected", F.col("stop_state")).alias("state"))
    body = F.struct(F.lit(Parser.of(grammar).grammar.name).alias("language"), stop.alias("stop"), "roots", "mends", "skipped", "supplied", "spurned")
    return trees.parses(docs, grammar, mend, key=key, text=text).select(key, F.to_json(body).alias("json"))


def state(spark: SparkSession, grammar: str, n: int) -> DataFrame:
    """(part, row) of one state: its kernel's items, what it shifts and what it reduces; a number beyond the tables is refused."""
    f = store.frames(spark, grammar)
    if f["states"].where(F.col("id") == n).isEmpty():
        raise ValueError(f"no state {n}")
    items = f["states"].where((F.col("id") == n) & F.col("kernel")).select(F.lit("item").alias("part"), F.col("item").alias("row"))
    names = f["symbols"].select(F.col("id").alias("terminal"), "name")
    acts = f["actions"].where(F.col("state") == n).join(names, "terminal", "left").select(F.col("verb").alias("part"), F.concat_ws(" ", "name", F.col("value").cast("string")).alias("row"))
    return items.unionByName(acts)


def holding(spark: SparkSession, grammar: str, item: str) -> DataFrame:
    """(id, item, kernel) of the states that hold a reading; one that begins with an arrow is sought under any rule."""
    states = store.frames(spark, grammar)["states"]
    wanted = " ".join(item.split())
    return states.where(F.col("item").endswith(f" {wanted}") if wanted.startswith("->") else F.col("item") == wanted)
