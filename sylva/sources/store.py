"""Grammars and texts in and out: grammar files, compiled artifacts as Parquet with a manifest, and text trees."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.parser import Parser
from ..plans.tables import item

REVISION = 1
SECTIONS = ("source", "symbols", "productions", "states", "edges", "actions", "conflicts")


class StoreError(ValueError):
    """An artifact that is not whole or not of this revision."""


def builtin(name: str) -> str:
    """Source of a grammar that ships with the package."""
    return (Path(__file__).parent.parent / "grammars" / f"{name}.json").read_text()


def with_scanner(grammar: str, book: str) -> str:
    """A grammar's source with a scanner book, which then answers for its external terminals."""
    return json.dumps(json.loads(grammar) | {"scanner": json.loads(book)})


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files, each whole."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sections(source: str) -> dict[str, tuple[str, list[tuple]]]:
    """(schema, rows) of each part of a compiled grammar."""
    p = Parser.of(source)
    g, t = p.grammar, p.tables
    return {
        "source": ("json string", [(source,)]),
        "symbols": ("id int, name string, shape string, terminal boolean, pattern string", [(k, g.symbol_name(k), g.shape(k), g.is_terminal(k), g.terminals[k].body if g.is_terminal(k) else None) for k in range(g.size)]),
        "productions": ("id int, lhs int, place int, symbol int, field string, alias string, dynamic int", [(k, x.lhs, j, s.symbol, s.field, s.alias[0] if s.alias else None, x.dynamic) for k, x in enumerate(g.productions) for j, s in enumerate(x.steps)]),
        "states": ("id int, item string, kernel boolean", [(k, item(g, *i), i in t.kernels[k]) for k, c in enumerate(t.closures) for i in sorted(c)]),
        "edges": ("state int, symbol int, to int", [(k, a, to) for k, e in enumerate(t.edges) for a, to in e.items()]),
        "actions": ("state int, terminal int, verb string, value int", [(k, a, v, x) for k, row in enumerate(t.actions) for a, offers in row.items() for v, x in offers]),
        "conflicts": ("state int, terminal int, kind string, verdict string, party string", [(c.state, c.terminal, c.kind, c.verdict, " ".join(c.party)) for c in t.conflicts]),
    }


def frames(spark: SparkSession, source: str) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in sections(source).items()}


def _seal(parts: dict) -> str:
    return hashlib.sha256(json.dumps([REVISION, {k: [s, [list(r) for r in rows]] for k, (s, rows) in parts.items()}], sort_keys=True).encode()).hexdigest()


def save(spark: SparkSession, source: str, path: str) -> str:
    """Write a compiled grammar under ``path/language=NAME``; returns its seal. Several grammars share one path."""
    parts, name = sections(source), Parser.of(source).grammar.name
    for section, (schema, rows) in parts.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/language={name}/{section}")
    spark.createDataFrame([(REVISION, name, _seal(parts))], "revision int, name string, seal string").coalesce(1).write.mode("overwrite").parquet(f"{path}/language={name}/manifest")
    return _seal(parts)


def load(spark: SparkSession, path: str, language: str) -> str:
    """Source of a saved grammar, after its revision, sections and seal are proved."""
    at = f"{path}/language={language}"
    try:
        m = spark.read.parquet(f"{at}/manifest").head()
        source = spark.read.parquet(f"{at}/source").head()["json"]
    except Exception as e:
        raise StoreError(f"no artifact of {language!r}") from e
    if m["revision"] != REVISION or m["name"] != language:
        raise StoreError(f"revision {m['revision']} of {m['name']!r}")
    parts = sections(source)
    for section, (schema, rows) in parts.items():
        got = spark.read.schema(schema).parquet(f"{at}/{section}")
        if sorted(map(repr, map(tuple, got.collect()))) != sorted(map(repr, rows)):
            raise StoreError(f"section {section!r} is not what its source compiles to")
    if m["seal"] != _seal(parts):
        raise StoreError("broken seal")
    return source
