"""Operator 2, n-gram Jaccard join: prefix filtering under several global orders, intersected before verification.

A document is the set of its distinct five-word shingles (64-bit hashes); two documents link when
100 * |intersection| >= 75 * |union|. In any global order of shingles, linked documents share k shingles among the
first n - ceil(0.75 n) + k of each, here with k = n / 10 of the smaller. The orders here put frequent shingles last (their class by a fixed-size count
sketch over all documents) and differ in the permutation inside a class. The first order proposes candidates through
a join on prefix shingles; a candidate pair goes on only if lengths allow a link and its prefixes meet in every other
order too; then the sets are intersected exactly.

No group of copies is expanded into pairs. Equal sets are one entity (128-bit digest). Shingles with the same holders
count once. Near copies have a home in common, whose documents are dealt into bounded blocks. The blocks of a home form
a tree and are compared with their parents first, whole and under all filters, which is one comparison a block and
joins most of a group. Then large components get blocks of their own, what is left of a home is dealt anew, and only
those pairs of blocks are compared that share a shingle, may link and aren't in one component as a whole; what all of
a group's blocks hold proposes nothing more. Blocks emit only the links that join members not joined yet, so
comparisons and links grow with a group's blocks, not with their square. ``links`` gives every link between different
texts instead, at the price of all pairs of blocks.

Defined results: null, empty and blank texts have size 0 and are alone. A null doc_id keeps its row, with its size and a null
component. Rows that repeat a doc_id are the same document (a doc_id names one text). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._spark import cut, lean, table
from ._text import Chunk, chunks, grams, mix, not_blank

SHINGLE = 5
SEEDS = (np.uint64(0x1234567), np.uint64(0x89ABCDE), np.uint64(0xF0E1D2C))
#: Counters of the frequency sketch, whatever the input's size.
CELLS = 1 << 22
BLOCKS = 16
#: Documents, and shingles, of a block at about the most. A longer document is a block of its own.
PART_ROWS = 64
PART_SHINGLES = 1 << 15
BLOCK = ["home", "part"]
OWN = 1 << 24
#: Blocks that are compared with one block of their home in the first pass, at most.
CHILDREN = 16
_WORD = not_blank()


def least_overlap(n: int) -> int:
    """Fewest shingles that a set of n shares with any set it links to."""
    return -(-75 * n // 100)


def least_shared(n):
    """Prefix shingles that a set of n shares with any set as large or larger that it links to.

    Prefixes are as many shingles longer than where one would do; a number or a Column.
    """
    return np.maximum(1, n // 10) if isinstance(n, int | np.ndarray) else F.greatest(F.lit(1), F.floor(n / 10))


def sets(c: Chunk) -> list[np.ndarray]:
    """The sorted distinct shingles of each row."""
    starts, ends, at = c.words(_WORD)
    h = c.hashes(starts, ends)
    g, offsets = grams(h, at, SHINGLE)
    out = []
    for r in range(c.hi - c.lo):
        words = at[r + 1] - at[r]
        if 0 < words < SHINGLE:
            short = h[at[r] : at[r + 1]]
            out.append(mix(np.array([int(sum((int(x) * (2 * k + 3) for k, x in enumerate(short)), 7 * int(words))) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.unique(g[offsets[r] : offsets[r + 1]]))
    return out


def _cells(s: np.ndarray) -> np.ndarray:
    return (mix(s ^ np.uint64(0xC0FFEE)) >> np.uint64(42)).astype(np.int64)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size and digest; of the partition its sketch, in blocks."""
    names = ["doc_id", "n", "k1", "k2", "block", "counts"]
    sketch = np.zeros(CELLS, np.uint32)
    some = False
    for b in batches:
        n, k1, k2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
        for c in chunks(b.column("text")):
            found = sets(c)
            for r, s in enumerate(found, c.lo):
                n[r], k1[r], k2[r] = len(s), mix(s ^ SEEDS[0]).sum(dtype=np.uint64), mix(s ^ SEEDS[1]).sum(dtype=np.uint64)
            if found:
                cells, n_cells = np.unique(_cells(np.concatenate(found)), return_counts=True)
                sketch[cells] += n_cells.astype(np.uint32)
                some = True
        nothing = [pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *nothing], names)
    if some:
        # a byte each: a shingle that a partition alone holds 255 times is frequent in any case
        parts = [x.tobytes() for x in np.split(np.minimum(sketch, 255).astype(np.uint8), BLOCKS)]
        empty = [pa.nulls(BLOCKS, pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*empty, pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the partition's blocks, one row a block."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, x in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
            total.setdefault(block, np.zeros(CELLS // BLOCKS, np.uint64))
            total[block] += np.frombuffer(x.as_py(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _sketch(parts: DataFrame) -> np.ndarray:
    """Frequency class of each cell: 0 for usual counts, then the binary logarithm of how far above the mean it is."""
    added = parts.repartition(BLOCKS, "block").mapInArrow(lean(_add_blocks), "block int, counts binary").toArrow()
    counts = np.zeros(CELLS, np.float64)
    for block, x in zip(added.column("block").to_pylist(), added.column("counts").to_pylist(), strict=True):
        counts[block * (CELLS // BLOCKS) :][: CELLS // BLOCKS] = np.frombuffer(x, np.uint64)
    # the usual load and its spread tell what is frequent; 8 is what a small input's cell must hold at least
    usual = max(8.0, counts.mean() + 4 * np.sqrt(counts.mean()))
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / usual))).astype(np.uint8)


def prefix(s: np.ndarray, classes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The first n - least_overlap(n) + least_shared(n) shingles of a set in the order of this seed."""
    p = len(s) - least_overlap(len(s)) + int(least_shared(len(s)))
    key = (classes[_cells(s)].astype(np.uint64) << np.uint64(58)) | (mix(s ^ seed) >> np.uint64(6))
    return s[np.argpartition(key, p - 1)[:p]] if p < len(s) else s


def _long(s: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in s])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *s]).view(np.int64)))


def _mapped(docs: DataFrame, make, name: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, the columns to keep, an array of shingles) of each document that has any."""
    kept = [docs.schema[c] for c in ("doc_id", *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                found = [(c.lo + r, s) for r, s in enumerate(sets(c)) if len(s)]
                rows = pa.array([r for r, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(f.name).take(rows) for f in kept], _long([make(s) for _, s in found])], [*[f.name for f in kept], name])

    return docs.mapInArrow(lean(run), T.StructType([*kept, T.StructField(name, T.ArrayType(T.LongType()))]))


def _held(docs: DataFrame, reps: DataFrame, classes) -> DataFrame:
    """(t, w, id): the holders of each shingle that several representatives have in their first order's prefix.

    Shingles with the same holders are one row a holder, w of them. Counting pre-aggregates before its shuffle.
    """
    first = cut(_mapped(docs, lambda s: prefix(s, classes.value, SEEDS[0]), "prefix").join(reps, "doc_id").dropDuplicates(["doc_id"]))
    dealt = first.select(F.explode("prefix").alias("t"), F.col("doc_id").alias("id"))
    shared = dealt.groupBy("t").agg(F.count("id").alias("holders"), F.bit_xor(F.xxhash64("id")).alias("who")).where("holders > 1")
    once = shared.groupBy("holders", "who").agg(F.min("t").alias("t"), F.count("t").alias("w"))
    # cut, so that what counting has shuffled leaves the disk before the join shuffles as much
    return dealt.join(cut(once.select("t", "w")), "t")


def _met(a: np.ndarray, at: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of ``a`` are in each of the given rows of the flat sets ``values``."""
    n = at[rows + 1] - at[rows]
    total = np.concatenate([[0], np.cumsum(n)])
    flat = values[np.arange(total[-1]) - np.repeat(total[:-1] - at[rows], n)]
    found = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    return np.add.reduceat(np.append(a[found] == flat, 0), total[:-1])


class _Block:
    """Some documents' sets, flat, with their prefixes under each further order."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], classes: np.ndarray):
        self.ids, self.sets, self.n = ids, sets, np.array([len(s) for s in sets])
        self.prefixes = [[np.sort(prefix(s, classes, seed)) for s in sets] for seed in SEEDS[1:]]
        self.flat = [self._flat(x) for x in (*self.prefixes, sets)]

    @staticmethod
    def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets)


def _links(x: _Block, y: _Block, parent: dict[int, int] | None) -> Iterator[tuple[int, int]]:
    """Links between two blocks: all, or with ``parent`` those that join documents not yet joined in it."""

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for i, a in enumerate(x.sets):
        rows = np.arange(i + 1 if x is y else 0, len(y.sets))
        rows = rows[100 * np.minimum(y.n[rows], len(a)) >= 75 * np.maximum(y.n[rows], len(a))]
        for k in range(len(SEEDS) - 1):
            if len(rows):
                rows = rows[_met(x.prefixes[k][i], *y.flat[k], rows) >= least_shared(np.minimum(y.n[rows], len(a)))]
        if len(rows):
            both = _met(a, *y.flat[-1], rows)
            for j in rows[100 * both >= 75 * (len(a) + y.n[rows] - both)]:
                if parent is not None:
                    p, q = root(int(x.ids[i])), root(int(y.ids[j]))
                    if p == q:
                        continue
                    parent[max(p, q)] = min(p, q)
                yield int(x.ids[i]), int(y.ids[j])


def _verified(pairs: DataFrame, blocks: DataFrame, classes, own: bool, spanning: bool = True) -> DataFrame:
    """Links (a, b) in what the blocks (home, part) of each pair hold: other orders' prefixes, then sets.

    ``own``: inside each block too, unless all its members have one root. ``spanning``: only links that join what neither ``roots`` of the blocks nor a link
    of the same task and first block has joined. A row holds two blocks; the first stays as it is while rows agree in it, as they
    mostly do after the join.
    """

    def block(batch: pa.RecordBatch, k: str, r: int) -> tuple[_Block, dict[int, int]]:
        ids = np.asarray(batch.column(f"ids{k}")[r].values)
        made = _Block(ids, [np.asarray(s.values).view(np.uint64) for s in batch.column(f"sets{k}")[r].values], classes.value)
        return made, dict(zip(ids.tolist(), batch.column(f"roots{k}")[r].as_py(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, parent = None, None, {}
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                ka, kb = ((batch.column(f"home{k}")[r].as_py(), batch.column(f"part{k}")[r].as_py()) for k in "ab")
                if ka != key:
                    key, (x, parent) = ka, block(batch, "a", r)
                y = x
                if ka != kb:
                    y, roots = block(batch, "b", r)
                    for k, at in roots.items():
                        parent.setdefault(k, at)
                out += _links(x, y, parent if spanning else None)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["a", "b"])

    side = lambda k: blocks.select(*[F.col(c).alias(c + k) for c in (*BLOCK, "ids", "sets", "roots")])
    met = pairs.join(side("b"), ["homeb", "partb"]).join(side("a"), ["homea", "parta"])
    if own:
        nothing = {f"{c}b": F.lit(None).cast(blocks.schema[c].dataType) for c in ("ids", "sets", "roots")}
        met = side("a").where(F.size(F.array_distinct("rootsa")) > 1).withColumns({"homeb": F.col("homea"), "partb": F.col("parta"), **nothing}).unionByName(met)
    return met.mapInArrow(lean(run), "a long, b long")


def _placed(held: DataFrame) -> DataFrame:
    """(id, n, home, part): a document's home is the least-hashed holder of all its shared shingles, which near copies
    have in common; the documents of a home are dealt into parts of about ``PART_ROWS`` documents or ``PART_SHINGLES`` shingles.
    """
    lead = held.groupBy("t").agg(F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("lead"))).alias("x"))
    home = held.join(lead, "t").groupBy("id").agg(F.min("x").alias("x"), F.first("n").alias("n"), F.sum("w").alias("w"))
    home = cut(home.where(F.col("w") >= least_shared(F.col("n"))).select("id", "n", F.col("x.lead").alias("home")))
    parts = home.groupBy("home").agg(F.greatest(F.ceil(F.count("id") / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    return cut(home.join(parts, "home").select("id", "n", "home", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")))


def _gathered(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """The blocks with their documents' ids and sets."""
    members = docs.join(placed.select(F.col("id").alias("doc_id"), *BLOCK), "doc_id").dropDuplicates(["doc_id"])
    sets_ = _mapped(members, lambda s: s, "shingles", BLOCK)
    return cut(sets_.groupBy(*BLOCK).agg(F.collect_list("doc_id").alias("ids"), F.collect_list("shingles").alias("sets")))


def _tree(placed: DataFrame) -> DataFrame:
    """Each block of a home with its parent; a parent has ``CHILDREN`` at most, so no block is in more pairs than these."""
    child = placed.select(*BLOCK).where("part > 0").distinct()
    parent = F.floor((F.col("part") - 1) / CHILDREN).cast("int")
    pairs = child.select(F.col("home").alias("homea"), parent.alias("parta"), F.col("home").alias("homeb"), F.col("part").alias("partb"))
    return pairs.join(placed.select(F.col("home").alias("homea"), F.col("part").alias("parta")).distinct(), ["homea", "parta"], "left_semi")


def _redealt(placed: DataFrame, blocks: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, blocks) anew where a home has several parts: components of near (id, component) that would fill half a
    block get blocks of their own, the other documents are dealt over fewer.
    """
    several = placed.where("part > 0").select("home").distinct()
    large = near.groupBy("component").count().where(F.col("count") >= PART_ROWS // 2).select("component")
    moved = placed.join(several, "home", "left_semi").join(near.join(large, "component", "left_semi"), "id", "left")
    moved = moved.select("id", "n", F.coalesce("component", "home").alias("home"), F.col("component").isNotNull().alias("own"))
    parts = moved.groupBy("home", "own").agg(F.greatest(F.ceil(F.count("id") / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), "parts").cast("int")
    # parts of components and of what is left are numbered apart from those that stay
    moved = cut(moved.join(parts, ["home", "own"]).select("id", "n", "home", F.when(F.col("own"), part + OWN).otherwise(-1 - part).alias("part")))
    sets_ = blocks.join(several, "home", "left_semi").select(F.explode(F.arrays_zip("ids", "sets")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.sets").alias("set"))
    made = sets_.join(moved.drop("n"), "id").groupBy(*BLOCK).agg(F.collect_list("id").alias("ids"), F.collect_list("set").alias("sets"))
    return cut(placed.join(several, "home", "left_anti").unionByName(moved)), cut(blocks.join(several, "home", "left_anti").unionByName(made))


def _pairs(held: DataFrame, placed: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of blocks that share a shingle, may link and have not one common ``label`` (null: several).

    What two blocks share bounds what any of their members do. A shingle all of whose blocks have one label proposes nothing.
    """
    seen = held.select("t", "w", "id").join(placed.join(label, BLOCK), "id").groupBy("t", "w", *BLOCK, "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    open_ = seen.groupBy("t").agg(F.count("part").alias("blocks"), F.min("label").alias("least"), F.max("label").alias("most"), F.max(F.col("label").isNull()).alias("mixed"))
    seen = cut(seen.join(open_.where("blocks > 1 and (mixed or least < most)").select("t"), "t", "left_semi"))
    a, b = (seen.select("t", F.col("w").alias("w" + k), *[F.col(c).alias(c + k) for c in (*BLOCK, "label", "lo", "hi")]) for k in "ab")
    near = (75 * F.col("loa") <= 100 * F.col("hib")) & (75 * F.col("lob") <= 100 * F.col("hia"))
    first = F.struct("homea", "parta") < F.struct("homeb", "partb")
    apart = F.col("labela").isNull() | F.col("labelb").isNull() | (F.col("labela") != F.col("labelb"))
    met = a.join(b, "t").where(first & near & apart).groupBy("homea", "parta", "homeb", "partb").agg(F.sum("wa").alias("w"), F.min(F.least("loa", "lob")).alias("lo"))
    return cut(met.where(F.col("w") >= least_shared(F.col("lo"))).drop("w", "lo"))


class _Found:
    """What the joins have in common: each row's size and digest, entities, holders and blocks."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        summary = cut(docs.mapInArrow(lean(_summary), "doc_id long, n long, k1 long, k2 long, block int, counts binary"))
        self.each = summary.where("block is null").select("doc_id", "n", "k1", "k2")
        self.classes = docs.sparkSession.sparkContext.broadcast(_sketch(summary.where("block is not null").select("block", "counts")))
        self.entities = self.each.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
        sizes = self.each.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("n").alias("n"))
        self.held = cut(_held(docs, self.entities.select(F.col("rep").alias("doc_id")).distinct(), self.classes).join(sizes, "id"))
        self.placed = _placed(self.held)
        self.blocks = _gathered(self.placed, docs)


def links(docs: DataFrame) -> DataFrame:
    """(a, b), a < b, of every link between different texts of docs (doc_id, text), each text by its smallest doc_id."""
    f = _Found(docs)
    pairs = _pairs(f.held, f.placed, f.placed.select(*BLOCK).distinct().withColumn("label", F.lit(None).cast("long")))
    out = _verified(pairs, f.blocks.withColumn("roots", F.col("ids")), f.classes, own=True, spanning=False)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    f = _Found(docs)
    near = cut(components(_verified(_tree(f.placed), f.blocks.withColumn("roots", F.col("ids")), f.classes, own=True)))
    placed, blocks = _redealt(f.placed, f.blocks, near)
    labels = placed.join(near, "id", "left").groupBy(*BLOCK).agg(F.collect_list(F.struct("id", F.coalesce("component", "id").alias("root"))).alias("named"))
    roots = F.array_sort(F.transform("named", lambda x: x["root"]))
    labels = cut(labels.select(*BLOCK, F.map_from_entries("named").alias("of"), F.when(roots[0] == F.element_at(roots, -1), roots[0]).alias("label")))
    pairs = _pairs(f.held, placed, labels.select(*BLOCK, "label"))
    rooted = blocks.join(labels.select(*BLOCK, "of"), BLOCK).withColumn("roots", F.transform("ids", lambda k: F.element_at("of", k))).drop("of")
    # a block dealt anew holds documents that no block held together before
    far = _verified(pairs, rooted, f.classes, own=True)
    found = components(near.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(far))

    # entities of several rows: each row has its entity's representative, and that its component
    named = f.entities.join(found, f.entities.rep == found.id, "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = f.each.join(named, ["k1", "k2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
