"""Operator 8, embedding near-dedup by product quantisation: inverted lists with residual codes, exact rerank.

Vectors are compared when label and dimension agree. Equal vectors of a label are one entity with a weight. A coarse
quantiser and residual subspace codebooks are fitted on at most ``MAX_FIT_ROWS`` vectors; every vector is then coded:
its list, its code, and its code's error e. Lists grow with the root of the vectors. A query x with nearest centroid c*
probes each list c with |x - c|^2 - |x - c*|^2 <= 2 d |c - c*|, where d is the distance of unit vectors at the
threshold: further off, the plane that parts the two lists is beyond d and with it all that c holds, so probes are
always sufficient. A member y of a probed list survives when the table-lookup
distance of x to y's code is at most d + e(y), again a bound that no linked vector fails, and survivors are
reranked by their exact cosine in double precision. Recall is therefore 1 up to rounding.

Lists are dealt out as blocks: members and queries of a list are split by hash into cells of about ``CELL_ROWS`` of each, so a hot label or
list becomes many tasks of bounded size. A cell emits no pairs: per entity the weight of its links there and the
smallest entity it is joined to inside the cell.

Defined results: null labels, null, empty, zero, null-holding and non-finite vectors link with nothing; each row of them
is its own component. A null vec_id keeps its row but links with nothing, with null component and kept false. Rows
that repeat a vec_id are vectors of their own that share a name. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._spark import bounded_rows, cut, table

THRESHOLD = 0.93
MAX_FIT_ROWS = 8_000
LEAST_LISTS = 24
SUBSPACES = 8
CODES = 64
CELL_ROWS = 4096
_EDGE = 1e-6


def _unit(rows: pa.Array, width: int) -> np.ndarray:
    """Vectors as unit rows in double precision, padded with zeros to ``width`` columns."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    out = np.zeros((len(rows), width))
    at, values = np.asarray(rows.offsets), np.asarray(rows.values).astype(np.float64)
    n = np.diff(at)
    out[np.repeat(np.arange(len(rows)), n), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)] = values[at[0] : at[-1]]
    # the largest component first: neither squares overflow nor tiny vectors vanish
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


@dataclass
class Index:
    """The quantisers; their sizes are parameters, whatever the input."""

    width: int
    lists: np.ndarray
    books: list[np.ndarray]
    parts: list[slice]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, error of the code) of each unit vector."""
        near = _distances(x, self.lists).argmin(1)
        residual = x - self.lists[near]
        codes = np.stack([_distances(residual[:, p], b).argmin(1) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return near, codes, np.linalg.norm(residual - back, axis=1)


def lists_for(vectors: int) -> int:
    """Coarse lists of so many vectors of a label: their root's third, with sixteen fitted vectors a list at least."""
    return min(max(LEAST_LISTS, int(vectors**0.5) // 3), MAX_FIT_ROWS // 16)


def fit(vectors: DataFrame, width: int, lists: int = LEAST_LISTS) -> Index:
    """Quantisers from a bounded sample of entities (id, embedding)."""
    sample = _unit(bounded_rows(vectors.select("id", "embedding"), "id", MAX_FIT_ROWS).select("embedding").toArrow().column(0), width)
    rng = np.random.default_rng(8)
    edges = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if not len(sample):
        return Index(width, np.zeros((1, width)), [np.zeros((1, p.stop - p.start)) for p in parts], parts)
    coarse = _kmeans(sample, lists, rng)
    residual = sample - coarse[_distances(sample, coarse).argmin(1)]
    return Index(width, coarse, [_kmeans(residual[:, p], CODES, rng) for p in parts], parts)


def _reach(threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold)) + _EDGE


def _placed(shared, threshold: float):
    """Of each entity its own list and the lists with a higher or equal number that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, d = shared.value, _reach(threshold)
        between = _distances(index.lists, index.lists)
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("embedding"), index.width)
            away = _distances(x, index.lists)
            own = away.argmin(1)
            beyond = away**2 - away.min(1, keepdims=True) ** 2 - 2 * d * between[own]
            probes = (beyond <= _EDGE) & (np.arange(away.shape[1]) >= own[:, None])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array([np.flatnonzero(p).astype(np.int32) for p in probes], pa.list_(pa.int32()))], [*b.schema.names, "list", "probes"])

    return run


def _cell(shared, threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: members of a list; right: queries that probe it."""
        names = ["id", "links", "root"]
        empty = pa.table([pa.array([], pa.int64())] * 3, names)
        if not left.num_rows or not right.num_rows:
            return empty
        index, d = shared.value, _reach(threshold)
        y, x = _unit(left.column("embedding"), index.width), _unit(right.column("embedding"), index.width)
        iy, ix = left.column("id").to_numpy(), right.column("id").to_numpy()
        wy, wx = left.column("weight").to_numpy(), right.column("weight").to_numpy()
        own = right.column("list").to_numpy() == left.column("list")[0].as_py()
        centre = index.lists[left.column("list")[0].as_py()]
        _, codes, error = index.code(y)
        limit = (d + error) ** 2 + _EDGE
        residual = x - centre
        tables = [_distances(residual[:, p], b) ** 2 for p, b in zip(index.parts, index.books, strict=True)]
        links, parent = {}, {}

        def root(k: int) -> int:
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for q in range(len(x)):
            near = tables[0][q][codes[:, 0]]
            for k in range(1, len(tables)):
                near = near + tables[k][q][codes[:, k]]
            at = np.flatnonzero(near <= limit)
            at = at[iy[at] < ix[q]] if own[q] else at
            at = at[y[at] @ x[q] >= threshold] if len(at) else at
            if len(at):
                i = int(ix[q])
                links[i] = links.get(i, 0) + int(wy[at].sum())
                for j in iy[at].tolist():
                    links[j] = links.get(j, 0) + int(wx[q])
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        if not links:
            return empty
        ids = sorted(links)
        return pa.table([pa.array(ids, pa.int64()), pa.array([links[i] for i in ids], pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    number = lambda x: x.cast("double")
    whole = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    fine = whole & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", fine.alias("fine"))
    rows = rows.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(7), "embedding", "label")})
    entities = rows.where("fine").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"))
    entities = cut(entities.withColumns({"id": F.col("k1"), "dim": F.size("embedding")}))
    width, most = entities.groupBy("label").agg(F.max("dim").alias("dim"), F.count(F.lit(1)).alias("n")).agg(F.max("dim"), F.max("n")).head()
    width = width or 1
    shared = spark.sparkContext.broadcast(fit(entities, width, lists_for(most or 0)))

    base = entities.select("id", "label", "dim", "embedding", "weight")
    placed = cut(base.mapInArrow(_placed(shared, threshold), T.StructType([*base.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("probes", T.ArrayType(T.IntegerType()))])))
    asked = placed.withColumn("asked", F.explode("probes")).drop("probes")
    # how many cells a list's members and queries are split into
    part = ["label", "dim", "asked"]
    members = placed.groupBy("label", "dim", F.col("list").alias("asked")).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("m"))
    queries = asked.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("q"))
    grid = members.join(queries, part)
    bucket = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = placed.withColumn("asked", F.col("list")).drop("probes").join(grid, part).withColumns({"mi": bucket("m"), "qi": F.explode(F.sequence(F.lit(0), F.col("q") - 1))})
    right = asked.join(grid, part).withColumns({"qi": bucket("q"), "mi": F.explode(F.sequence(F.lit(0), F.col("m") - 1))})
    cell = [*part, "mi", "qi"]
    keep = [*cell, "id", "embedding", "weight", "list"]
    found = cut(left.select(*keep).groupBy(*cell).cogroup(right.select(*[F.col(c).alias(c) for c in keep]).groupBy(*cell)).applyInArrow(_cell(shared, threshold), "id long, links long, root long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    labels = components(edges).withColumnRenamed("id", "cid")
    named = entities.select("k1", "k2", "id", "rep", "weight").join(labels, F.col("id") == F.col("cid"), "left").withColumn("group", F.coalesce("component", "id"))
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "group").join(links, "id", "left").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.lit(True).alias("fine"))
    out = rows.select("vec_id", "k1", "k2", "fine").join(named, ["k1", "k2", "fine"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
