"""Lines of texts: places in bytes, indent columns, shapes, and where an offset falls.

``find``, ``past`` and ``seek`` work inside one text and count characters, as Spark's string functions do; lines count bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAB = 8
MAX_COLUMN = 65535


def find(text: Column, characters: str, start: Column) -> Column:
    """Place from ``start`` (0-based) of the next character of a set; the length if there is none."""
    rest = F.regexp_instr(F.substring(text, start + 1, F.length(text)), F.lit(f"[{_quoted(characters)}]"))
    return F.when(rest > 0, start + rest - 1).otherwise(F.length(text))


def past(text: Column, characters: str, start: Column) -> Column:
    """End of the run of a set's characters that begins at ``start``."""
    return start + F.length(F.regexp_extract(F.substring(text, start + 1, F.length(text)), f"^[{_quoted(characters)}]*", 0))


def seek(text: Column, pair: str, start: Column) -> Column:
    """Place from ``start`` of the next occurrence of a two-character pair; the length if there is none."""
    at = F.locate(pair, F.substring(text, start + 1, F.length(text)))
    return F.when(at > 0, start + at - 1).otherwise(F.length(text))


def _quoted(characters: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in characters)


def column(line: Column) -> Column:
    """Indent column of a line's lead: a blank is one more, a tab goes to the next multiple of eight."""
    lead = F.split(F.regexp_extract(line, "^[ \t]*", 0), "")
    wide = F.aggregate(lead, F.lit(0), lambda n, c: F.when(c == "\t", (F.floor(n / TAB).cast("int") + 1) * TAB).when(c == " ", n + 1).otherwise(n))
    return F.least(wide, F.lit(MAX_COLUMN))


def shape(line: Column, last: Column, note: str) -> Column:
    """blank, note, code or rough; ``note`` opens a comment line; a lead that ends the text is rough."""
    body = F.regexp_replace(line, "^[ \t]+", "")
    return F.when((body == "") & last, "rough").when(body == "", "blank").when(body.rlike(r"^[\r\f\\]"), "rough").when(body.startswith(note), "note").when(body.startswith("/*"), "rough").otherwise("code")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, start, body, column, shape_hash, shape_slashes), places in bytes.

    Starts come from one pass over each batch's bytes, linear in them; the rest is Catalyst's. Nothing is shuffled. Null
    texts have no lines.
    """
    given = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("line"))
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n int, line_no int, start int, line string").fields])
    rows = given.mapInArrow(_split, schema)
    line, last = F.col("line"), F.col("line_no") == F.col("n") - 1
    body = F.col("start") + F.octet_length(F.regexp_extract(line, "^[ \t]*", 0))
    return rows.select(key, "line_no", "start", body.alias("body"), column(line).alias("column"), shape(line, last, "#").alias("shape_hash"), shape(line, last, "//").alias("shape_slashes"))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text with their starts: newlines are found in all bytes of a batch at once."""
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        if not len(texts):
            continue
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8)
        ends = np.flatnonzero(data[offsets[0] :] == 10) + offsets[0]
        below = np.searchsorted(ends, offsets)  # newlines before each text
        n = np.diff(below) + 1
        total = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(n)), n)
        line_no = np.arange(total[-1]) - total[row]
        starts, stops = np.empty(total[-1], np.int64), np.empty(total[-1], np.int64)
        starts[total[:-1]], stops[total[1:] - 1] = offsets[:-1], offsets[1:]
        starts[line_no > 0], stops[np.delete(np.arange(total[-1]), total[1:] - 1)] = ends + 1, ends
        # lines are slices of the same bytes, but for the newlines between them
        plain = data[offsets[0] :][data[offsets[0] :] != 10]
        at = np.concatenate([[0], np.cumsum(stops - starts)])
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(plain)]).cast(pa.large_string()).cast(pa.string())
        key = b.column(0).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([key, pa.array(n[row], pa.int32()), pa.array(line_no, pa.int32()), pa.array(starts - offsets[row], pa.int32()), text], [b.schema.names[0], "n", "line_no", "start", "line"])


def line_of(lines_: DataFrame, offsets: DataFrame, key: str = "doc_id") -> DataFrame:
    """offsets (key, at) with the line_no that holds each: an as-of join by one window over both."""
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = lines_.select(key, F.col("start").alias("at"), F.col("line_no"), F.lit(0).alias("side")).unionByName(offsets.select(key, "at", F.lit(None).cast("int").alias("line_no"), F.lit(1).alias("side")))
    return both.withColumn("line_no", F.last("line_no", True).over(w)).where("side = 1").select(key, "at", "line_no")


def after(lines_: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """lines with ``after``, the next line's start or the text's length in bytes."""
    w = Window.partitionBy(key).orderBy("line_no")
    ends = docs.select(key, F.octet_length(text).alias("__end"))
    return lines_.withColumn("after", F.lead("start").over(w)).join(ends, key).withColumn("after", F.coalesce("after", "__end")).drop("__end")


def leads(lines_: DataFrame, note: str = "hash", key: str = "doc_id") -> DataFrame:
    """lines with ``code_line``, the first line at or after each that is neither blank nor a comment."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    return lines_.withColumn("code_line", F.first(F.when(~F.col(f"shape_{note}").isin("blank", "note"), F.col("line_no")), True).over(w))


def where(text: Column, at: Column) -> Column:
    """(line, column) of a place, both from 1."""
    head = F.substring(text, F.lit(1), at)
    newlines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct((newlines + 1).alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("column"))
