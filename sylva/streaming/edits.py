"""Edits of texts by key: replayed in a batch, or kept in a stream's state. Trees follow from a fresh parse.

An edit is (key, seq, from, to, insert) in bytes of the text as it then stands; a first edit with from = to = 0 opens
a text. Edits of a key apply by seq. One out of range is refused and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"(\d+)\.\.(\d+)=(.*)", re.DOTALL)
COSTS = "doc_id long, seq long, refused boolean, bytes int, delta int, nodes int, kept int, minted int, resumed int, stop_kind string"


def script(text: str) -> tuple[int, int, str]:
    """FROM..TO=TEXT with \\n and \\t escapes."""
    m = _SCRIPT.fullmatch(text)
    if not m or int(m[2]) < int(m[1]):
        raise ValueError(f"not an edit: {text!r}")
    return int(m[1]), int(m[2]), m[3].replace("\\n", "\n").replace("\\t", "\t")


def applied(text: bytes, start: int, end: int, insert: str) -> bytes | None:
    """The text after a cut; None if it is out of range or splits a character."""
    if not 0 <= start <= end <= len(text):
        return None
    out = text[:start] + (insert or "").encode() + text[end:]
    try:
        out.decode()
    except UnicodeDecodeError:
        return None
    return out


def replay(edits: DataFrame) -> DataFrame:
    """(doc_id, text, edits): each key's final text. One shuffle by key; a key's edits are one group, as they depend on each other."""

    def run(t: pa.Table) -> pa.Table:
        text, n = b"", 0
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("seq", "from", "to", "insert")), strict=True))
        for _, start, end, insert in rows:
            new = applied(text, start, end, insert)
            if new is not None:
                text, n = new, n + 1
        return pa.table({"doc_id": [t.column("doc_id")[0].as_py()], "text": [text.decode()], "edits": pa.array([n], pa.int32())})

    return edits.where("doc_id is not null").select("doc_id", "seq", "from", "to", "insert").groupBy("doc_id").applyInArrow(run, "doc_id long, text string, edits int")


def amends(edits: DataFrame, grammar: str) -> DataFrame:
    """The costs of every edit, as ``live`` has them, of edits in a batch. One shuffle by key; a key's edits travel as one row."""
    from ..plans.parser import Parser

    parser = Parser.of(grammar)
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in COSTS.split(", ")]
    names = ("seq", "from", "to", "insert")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, edits_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += costs(parser, key, b"", sorted(tuple(e[n] for n in names) for e in edits_))[0]
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[kind]) for (_, kind), c in zip(fields, columns, strict=True)], [name for name, _ in fields])

    return edits.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("edits")).mapInArrow(run, COSTS)


def costs(parser, key, text: bytes, rows) -> tuple[list[tuple], bytes]:
    """(a row of costs for each edit (seq, from, to, insert), the text after them)"""
    from ..plans.parser import flat

    session, out = Session(parser, text.decode()), []
    known = _shapes(session.tree, session.text, flat)
    for seq, start, end, insert in rows:
        new = applied(text, start, end, insert)
        delta = 0 if new is None else len(new) - len(text)
        if new is not None:
            session.amend(len(text[:start].decode()), len(text[:end].decode()), insert or "")
            text = new
        shapes = _shapes(session.tree, session.text, flat)
        kept, known = len(shapes & known), shapes
        out.append((key, seq, new is None, len(text), delta, len(shapes), kept, len(shapes) - kept, len(session.text[: session.resumed].encode()), session.tree.stop))
    return out, text


class Session:
    """A text under edit. A parse goes on from the last ring before a cut, and is as a fresh one would be."""

    def __init__(self, parser, text: str = "", mend: str = "fell", reuse: bool = True):
        self.parser, self.mend, self.reuse = parser, mend, reuse
        self.rings: list = []
        self.read(text)

    def read(self, text: str) -> None:
        """Replace the text."""
        self.text, self.resumed = text, 0
        self.rings.clear()
        self.tree = self.parser.parse(text, self.mend, self.rings)

    def amend(self, start: int, end: int, insert: str) -> None:
        """Cut [start, end), in characters, and write ``insert`` there; ``resumed`` is where parsing went on."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError(f"{start}..{end} is out of a text of {len(self.text)}")
        self.text = self.text[:start] + insert + self.text[end:]
        while self.rings and (self.rings[-1].reach > start or not self.reuse):
            self.rings.pop()
        self.resumed = self.rings[-1].at if self.rings else 0
        self.tree = self.parser.parse(self.text, self.mend, self.rings)


def live(stream: DataFrame, grammar: str) -> DataFrame:
    """A streaming frame of edits to a row of costs for each: the tree's size, and how many nodes the edit kept or minted.

    State is the text of a key; rings live as long as a batch. Trees equal those of a fresh parse, so what they hold never
    depends on the edits' way.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    from ..plans.parser import Parser

    parser = Parser.of(grammar)

    class Texts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.text = handle.getValueState("text", "text string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            text = self.text.get()[0].encode() if self.text.exists() else b""
            given = pd.concat(list(rows)).sort_values("seq")[["seq", "start", "end", "insert"]]
            out, text = costs(parser, key[0], text, [(int(q), int(i), int(j), x) for q, i, j, x in given.itertuples(index=False)])
            self.text.update((text.decode(),))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COSTS.split(", ")])

        def close(self) -> None:
            pass

    named = stream.select("doc_id", "seq", F.col("from").alias("start"), F.col("to").alias("end"), "insert")
    return named.groupBy("doc_id").transformWithStateInPandas(Texts(), COSTS, "Append", "None")


def _shapes(tree, text: str, flat) -> set:
    """Nodes by kind, depth, text and occurrence, which are alike before and after an edit elsewhere."""
    seen: dict = {}
    out = set()
    for n, _, _, _, _, depth, _ in flat(tree.roots):
        key = (n.kind, depth, text[n.start : n.end])
        seen[key] = seen.get(key, 0) + 1
        out.add((*key, seen[key]))
    return out
