"""Connected components over a DataFrame of links: labels only ever meet in joins, never on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, lean

#: Edges that a task joins in memory: a hundred MB or two.
FOREST = 1 << 19
#: Edges of an id beyond which its label goes by broadcast; there are at most 2 * edges / HOT such ids.
HOT = 1 << 17


def _forest(edges: DataFrame, n: int, most: int) -> DataFrame:
    """n edges as stars: (id, the smallest id that a task's own edges join it to), about ``most`` edges a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        def stars() -> pa.RecordBatch:
            ids = [k for k in parent if root(k) != k]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(k) for k in ids], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
                if len(parent) > 2 * most:
                    yield stars()
                    parent.clear()
        yield stars()

    return edges.coalesce(max(1, -(-n // most))).mapInArrow(lean(run), "a long, b long").distinct()


def _joined(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """edges with the ``m`` that ``least`` (key, m, n) has for their key. No hot key is shuffled."""
    hot, rest = least.where(F.col("n") > HOT).drop("n"), least.where(F.col("n") <= HOT).drop("n")
    return edges.join(F.broadcast(hot), key).unionByName(edges.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def _round(edges: DataFrame, n: int, most: int) -> DataFrame:
    """Large-star, then small-star (Kiveris et al. 2014), then the tasks' own forests. Edges (a, b) have b < a."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("b")).agg(F.least(F.first("a"), F.min("b")).alias("m"), F.count("b").alias("n"))
    large = _joined(edges, least, "b").select("a", F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n"))
    small = _joined(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _forest(small.union(low.select("a", "m")).distinct(), n, most)


def _state(edges: DataFrame) -> tuple[int, int]:
    """(edges, ids that have two smaller neighbours, or both a smaller and a larger one): stars have none of these."""
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("least"), F.col("b").alias("most"), F.lit(0).alias("above"))
    ends = ends.union(edges.select("b", F.lit(None), F.lit(None), F.lit(1)))
    seen = ends.groupBy("id").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("above").alias("above"))
    n, wrong = seen.agg(F.sum("above"), F.count_if((F.col("least") < F.col("most")) | (F.col("least").isNotNull() & (F.col("above") > 0)))).head()
    return n or 0, wrong


def components(links: DataFrame, most: int = FOREST) -> DataFrame:
    """(id, component) of every id in links (a, b), component being the smallest id reachable.

    Edges are joined in memory by tasks of about ``most`` of them; what spans tasks is settled by rounds. Every round
    lowers the sum of the edges' ends until all are stars around the smallest ids, so it ends whatever the shape and
    order of a chain, in a number of rounds that grows with the square of the logarithm of the ids at most. Ids are
    pre-aggregated before shuffles and hot ones split. Links of an id to itself give a component of its own; an empty
    table gives an empty result.
    """
    given = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    given = cut(given.where("a is not null and b is not null").distinct())
    edges = cut(_forest(given.where("a <> b"), given.count(), most))
    n, wrong = _state(edges)
    while wrong:
        edges = cut(_round(edges, n, most))
        n, wrong = _state(edges)
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b")).union(given.where("a = b").select("a", "b"))
    return ids.groupBy("id").agg(F.min("component").alias("component"))
