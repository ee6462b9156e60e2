"""Operator 3, benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

Words are maximal runs of digits, A-Z (folded) and characters outside ASCII. A window is ten consecutive words of an
item; a shorter item that has a word is one window. The windows' words are ordered by rarity, counted over all
documents; as containment must be complete, a window's necessary prefix is its one rarest word. A document position
that holds a prefix word proposes the windows with that prefix: the window must lie inside the document (length and
positional bounds, from the prefix word's place in the window), the hashes of all its words must agree, and last its
words themselves.

The distinct windows are a table of their own, made from the items in tasks; their bytes are summed there. What fits in
``MAX_BROADCAST_BYTES`` is joined by broadcast; a larger benchmark is dealt into blocks of that many bytes by the windows'
hash, and ``find`` passes over the documents once for each, so that neither the driver nor a task ever holds more than a block.

Defined results: null, empty and wordless texts have no words and no hits; wordless items occur nowhere; a repeated
item counts as each of its item_ids; rows with a null item_id are no items; repeated documents get the same answer;
empty tables give no hits or no rows. Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import append, cut, lean, table
from ._text import Chunk, alphanumeric, chunks

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
_WORD = alphanumeric()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = c.words(_WORD)
    return starts, ends, at, c.hashes(starts, ends)


def _plain(c: Chunk, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words as they are compared: folded and joined by blanks."""
    return b" ".join(_LOWER[c.data[s:e]].tobytes() for s, e in zip(starts, ends, strict=True))


@dataclass
class Windows:
    """Distinct windows, sorted by their prefix word's hash."""

    key: np.ndarray  # hash of the prefix word
    place: np.ndarray  # its position in the window
    size: np.ndarray
    hashes: np.ndarray  # of all words, 0 after a short window's end
    plain: list[bytes]
    items: list[list[str]]  # which have the window


def item_windows(items: DataFrame) -> DataFrame:
    """(plain, hashes, items): each distinct window's folded words and their hashes, and the items that have it, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                starts, ends, at, h = _words(c)
                rows, plain, hashes = [], [], []
                for r in range(c.hi - c.lo):
                    n = at[r + 1] - at[r]
                    for s in range(at[r], at[r] + max(n - WINDOW, 0) + 1) if n else ():
                        e = min(s + WINDOW, at[r + 1])
                        rows.append(c.lo + r), plain.append(_plain(c, starts[s:e], ends[s:e])), hashes.append(h[s:e].view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(rows, pa.int64())), pa.array(plain, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "plain", "hashes"])

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    found = rows.mapInArrow(lean(run), "item_id string, plain binary, hashes array<long>")
    return found.groupBy("plain").agg(F.first("hashes").alias("hashes"), F.sort_array(F.collect_set("item_id")).alias("items"))


def _blocks(windows: DataFrame, most: int) -> Iterator[dict[bytes, tuple[np.ndarray, list[str]]]]:
    """The windows in blocks of about ``most`` bytes, one at a time; a single empty one where there are none."""
    size = F.octet_length("plain") + 8 * F.size("hashes") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 4)
    windows = cut(windows)
    total = windows.agg(F.sum(size)).head()[0] or 0
    blocks = max(1, -(-total // most))
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("plain"), F.lit(blocks)) == k).toArrow()
        yield {p: (np.array(h, np.int64).view(np.uint64), x) for p, h, x in sorted(zip(*(rows.column(n).to_pylist() for n in ("plain", "hashes", "items")), strict=True))}


def _count(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = vocabulary.value, np.zeros(len(vocabulary.value), np.int64)
        maybe = _screen(words)
        for b in batches:
            for c in chunks(b.column("text")):
                h = _words(c)[3]
                h = h[maybe[(h & _LOW).astype(np.int64)]]
                k = np.searchsorted(words, h)
                k = k[words[np.minimum(k, len(words) - 1)] == h]
                total += np.bincount(k, minlength=len(words))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    return run


_LOW = np.uint64((1 << 20) - 1)


def _screen(keys: np.ndarray) -> np.ndarray:
    """A bitmap over the low bits of the keys, asked before the search."""
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys & _LOW).astype(np.int64)] = True
    return maybe


def rarity_ordered(docs: DataFrame, windows: dict[bytes, tuple[np.ndarray, list[str]]]) -> Windows:
    """The windows with their prefix words: the rarest in all of docs, then by hash."""
    words = np.unique(np.concatenate([h for h, _ in windows.values()]))
    shared = docs.sparkSession.sparkContext.broadcast(words)
    counts = docs.select("text").mapInArrow(lean(_count(shared)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(words), np.int64)
    frequency[counts.column("word").to_numpy()] = counts.column("n").to_numpy()
    key, place, size, hashes = [], [], [], np.zeros((len(windows), WINDOW), np.uint64)
    for k, (h, _) in enumerate(windows.values()):
        rank = frequency[np.searchsorted(words, h)]
        p = int(np.lexsort((h, rank))[0])
        key.append(h[p]), place.append(p), size.append(len(h))
        hashes[k, : len(h)] = h
    key = np.array(key, np.uint64)
    order = np.argsort(key, kind="stable")
    plain, items = list(windows), [x for _, x in windows.values()]
    return Windows(key[order], np.array(place)[order], np.array(size)[order], hashes[order], [plain[k] for k in order], [items[k] for k in order])


def _occurrences(c: Chunk, w: Windows, maybe: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Word offset of each row; (row, first word, window) of each verified occurrence."""
    starts, ends, at, h = _words(c)
    place = np.flatnonzero(maybe[(h & _LOW).astype(np.int64)])
    lo, hi = np.searchsorted(w.key, h[place], "left"), np.searchsorted(w.key, h[place], "right")
    n = hi - lo
    place, n, lo = place[n > 0], n[n > 0], lo[n > 0]
    window = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    place = np.repeat(place, n)
    row = np.searchsorted(at, place, "right") - 1
    first = place - w.place[window]
    ok = (first >= at[row]) & (first + w.size[window] <= at[row + 1])
    row, first, window = row[ok], first[ok], window[ok]
    for j in range(WINDOW):
        ok = (w.size[window] <= j) | (h[np.minimum(first + j, len(h) - 1)] == w.hashes[window, j]) if len(first) else np.zeros(0, bool)
        row, first, window = row[ok], first[ok], window[ok]
    same = [(int(r), int(f), int(k)) for r, f, k in zip(row, first, window, strict=True) if _plain(c, starts[f : f + w.size[k]], ends[f : f + w.size[k]]) == w.plain[k]]
    return at, same


def find(docs: DataFrame, items: DataFrame, text: str = "text", drop: tuple = (), most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs with ``n_words``, ``hits`` (disjoint [first, end) runs of hit words) and ``items`` (sorted item ids)."""
    runs, ids = T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType())
    names = [n for n in docs.columns if n not in ("n_words", "hits", "items", *drop)]
    for k, block in enumerate(_blocks(item_windows(items), most)):
        docs = _pass(docs, block, text, (), k > 0, runs, ids)
    return docs.select(*names, "n_words", "hits", "items")


def _pass(docs: DataFrame, block: dict, text: str, drop: tuple, more: bool, runs: T.DataType, ids: T.DataType) -> DataFrame:
    """One block of windows; ``more``: an earlier pass has left hits and items, which stay."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(rarity_ordered(docs.select(F.col(text).alias("text")), block) if block else None)
    given = ["hits", "items"] if more else []
    if more:
        docs = docs.withColumnsRenamed({n: f"__{n}" for n in given})

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        w = shared.value
        maybe = _screen(w.key) if w else None
        n_words, hits, found = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
        if more:
            hits, found = b.column("__hits").to_pylist(), [set(x) for x in b.column("__items").to_pylist()]
        for c in chunks(b.column(text)):
            at, same = _occurrences(c, w, maybe) if w else (c.words(_WORD)[2], [])
            n_words[c.lo : c.hi] = np.diff(at)
            for r, f, k in same:
                hits[c.lo + r].append([f - int(at[r]), f - int(at[r]) + int(w.size[k])])
                found[c.lo + r].update(w.items[k])
        return [pa.array(n_words), pa.array([_joined(x) for x in hits], pa.list_(pa.list_(pa.int32()))), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]

    return append(docs, make, [("n_words", T.LongType()), ("hits", runs), ("items", ids)], (*drop, *(f"__{n}" for n in given)))


def _joined(hits: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(hits):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), drop=("text",))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, win, len(win) AS k FROM (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, w[i:i + k - 1] AS win FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
