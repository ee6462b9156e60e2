"""Ordered folds of associative compositions over keyed rows.

A fold whose order matters can't use a plain aggregate. Rows are cut into runs of ``run`` positions, each run is folded
in order, and then the runs' products; no task holds more than a run of rows, and a key's products are one a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 512


def excess(words: DataFrame, key: str = "doc_id", at: str = "k", step: str = "step", run: int = RUN) -> DataFrame:
    """(key, total, low, high) of +1/-1 words; low and high include the empty prefix."""
    d = F.col(step)
    inner = Window.partitionBy(key, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    runs = words.withColumn("__b", F.floor(F.col(at) / run)).withColumn("__p", F.sum(d).over(inner))
    runs = runs.groupBy(key, "__b").agg(F.sum(d).alias("t"), F.min("__p").alias("l"), F.max("__p").alias("h"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = runs.withColumn("__o", before).groupBy(key).agg(F.sum("t").alias("total"), F.min(F.col("__o") + F.col("l")).alias("low"), F.max(F.col("__o") + F.col("h")).alias("high"))
    return out.select(key, "total", F.least("low", F.lit(0)).alias("low"), F.greatest("high", F.lit(0)).alias("high"))


def balanced(excess_: DataFrame) -> DataFrame:
    return excess_.withColumn("balanced", (F.col("total") == 0) & (F.col("low") == 0))


def ordered(rows: DataFrame, element: Column, zero: Column, compose: Callable[[Column, Column], Column], key: str = "doc_id", at: str = "k", run: int = RUN) -> DataFrame:
    """(key, product) under any associative composition given on Columns, e.g. concatenation or a partial one with null as hole."""
    e = rows.select(key, F.floor(F.col(at) / run).alias("__b"), F.struct(F.col(at).alias("at"), element.alias("e")).alias("x"))
    fold = lambda c: F.aggregate(F.array_sort(F.collect_list(c)), zero, lambda acc, s: compose(acc, s["e"]))
    runs = e.groupBy(key, "__b").agg(fold(F.col("x")).alias("e"))
    return runs.groupBy(key).agg(fold(F.struct(F.col("__b").alias("at"), F.col("e").alias("e"))).alias("product"))


def between(rows: DataFrame, ranges: DataFrame, key: str = "doc_id", at: str = "k") -> DataFrame:
    """rows of each range (key, from, to), half open, ready for a fold by (key, from, to)."""
    return rows.join(ranges, key).where((F.col(at) >= F.col("from")) & (F.col(at) < F.col("to")))


def places(leaves: DataFrame, key: str = "doc_id", at: str = "k", size: str = "bytes") -> DataFrame:
    """leaves with ``offset``, the sum of the sizes before each."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def touched(placed: DataFrame, cuts: DataFrame, key: str = "doc_id", size: str = "bytes") -> DataFrame:
    """Leaves that a cut (key, from, to) disturbs; an insertion on a boundary disturbs none."""
    lo, hi = F.col("offset"), F.col("offset") + F.col(size)
    return placed.join(cuts, key).where((F.col("from") < hi) & (lo < F.col("to")) | (F.col("from") == F.col("to")) & (lo < F.col("from")) & (F.col("from") < hi))
