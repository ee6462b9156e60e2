"""Navigation over node rows with joins and windows. Every operator partitions by the document's key.

Ancestors are intervals: a is one of d when a.pre < d.pre <= a.last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "doc_id"

# Spark takes parsed rows for as few bytes as their texts, and would broadcast them: joins of node rows are hinted to merge.


def _run(key: str):
    return Window.partitionBy(key, F.coalesce("parent", F.lit(-1))).orderBy("ord")


def parent(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """nodes with ``parent_kind``; null for roots."""
    up = nodes.select(key, F.col("ref").alias("parent"), F.col("kind").alias("parent_kind"))
    return nodes.join(up.hint("merge"), [key, "parent"], "left")


def siblings(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """nodes with next and previous siblings, and the nearest named ones."""
    w = _run(key)
    named = F.when(F.col("named"), F.col("ref"))
    return nodes.withColumns({
        "next": F.lead("ref").over(w), "prev": F.lag("ref").over(w),
        "next_named": F.first(named, True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "prev_named": F.last(named, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })


def children(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """(key, parent, ord, ref, kind) of every child."""
    return nodes.where(F.col("parent").isNotNull()).select(key, "parent", "ord", "ref", "kind")


def by_field(nodes: DataFrame, field: str, key: str = KEY) -> DataFrame:
    """(key, ref of the parent, child): the first child with a field."""
    return nodes.where((F.col("field") == field) & F.col("parent").isNotNull()).groupBy(key, F.col("parent").alias("ref")).agg(F.min_by("ref", "ord").alias("child"))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent").isNull())


def sizes(nodes: DataFrame) -> DataFrame:
    """nodes with ``size``, their subtree's, themselves counted."""
    return nodes.withColumn("size", F.col("last") - F.col("pre") + 1)


def covering(nodes: DataFrame, ranges: DataFrame, key: str = KEY) -> DataFrame:
    """ranges (key, from, to) with ``ref`` of the deepest node around each; null where none is. Ties go to the first in source order."""
    r = ranges.withColumn("__r", F.monotonically_increasing_id())
    hit = r.join(nodes.select(key, "ref", "start", "end", "depth", "pre").hint("merge"), key).where((F.col("start") <= F.col("from")) & (F.col("to") <= F.col("end")))
    best = hit.groupBy(key, "from", "to").agg(F.max_by("ref", F.struct("depth", -F.col("pre"))).alias("ref"))
    return ranges.join(best, [key, "from", "to"], "left")


def ancestors(nodes: DataFrame, of: DataFrame, key: str = KEY) -> DataFrame:
    """(key, ref, ancestor, ancestor_depth) for the nodes ``of`` (key, ref), by interval. Where the trees are still to be
    parsed, the column ``above`` of ``trees.nodes`` gives the same without a join.
    """
    low = of.join(nodes.select(key, "ref", "pre").hint("merge"), [key, "ref"]).select(key, "ref", F.col("pre").alias("__p"))
    up = nodes.select(key, F.col("ref").alias("ancestor"), F.col("pre").alias("__a"), F.col("last").alias("__l"), F.col("depth").alias("ancestor_depth"))
    return low.join(up.hint("merge"), key).where((F.col("__a") < F.col("__p")) & (F.col("__p") <= F.col("__l"))).select(key, "ref", "ancestor", "ancestor_depth")


def lowest_common(nodes: DataFrame, pairs: DataFrame, key: str = KEY) -> DataFrame:
    """pairs (key, a, b) with ``lca``; null across trees. A node is its own ancestor here."""
    at = lambda c: nodes.select(key, F.col("ref").alias(c), F.col("pre").alias(f"__{c}"))
    both = pairs.join(at("a"), [key, "a"]).join(at("b"), [key, "b"])
    up = nodes.select(key, "ref", "pre", "last", "depth")
    held = both.join(up, key).where((F.col("pre") <= F.least("__a", "__b")) & (F.greatest("__a", "__b") <= F.col("last")))
    return pairs.join(held.groupBy(key, "a", "b").agg(F.max_by("ref", "depth").alias("lca")), [key, "a", "b"], "left")


def sheet(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """nodes with first and last child besides their siblings."""
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(key, F.col("parent").alias("ref")).agg(F.min_by("ref", "ord").alias("first_child"), F.max_by("ref", "ord").alias("last_child"))
    return siblings(nodes, key).join(kids, [key, "ref"], "left")


def parens(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """(key, k, open): the trees as balanced words. A node opens after all opened before and all closed before it."""
    word = lambda is_open, k: F.struct(F.lit(is_open).alias("open"), k.alias("k"))
    both = F.array(word(True, 2 * F.col("pre") - F.col("depth")), word(False, 2 * F.col("last") - F.col("depth") + 1))
    return nodes.select(key, F.explode(both).alias("w")).select(key, "w.open", "w.k")


def survey(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """Soundness by document: nodes, and how many are loose (outside their parent), out of order, or torn (reached not once)."""
    w = _run(key)
    up = nodes.select(key, F.col("ref").alias("parent"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    rows = nodes.withColumns({"__before": F.lag("end").over(w), "__same": F.count(F.lit(1)).over(Window.partitionBy(key, "ref"))}).join(up.hint("merge"), [key, "parent"], "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    torn = (F.col("__same") > 1) | (F.col("parent").isNotNull() & F.col("__s").isNull())
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("nodes"), count((F.col("start") < F.col("__s")) | (F.col("end") > F.col("__e")))("loose"), count(F.col("__before") > F.col("start"))("disorder"), count(torn)("torn"))


def outline(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """(key, pre, line): one named node a line, two blanks a level."""
    field = F.when(F.col("field").isNotNull(), F.concat("field", F.lit(": "))).otherwise("")
    return nodes.where("named").select(key, "pre", F.concat(F.expr("repeat('  ', depth)"), field, "kind", F.lit(" ["), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"), F.lit(")")).alias("line"))
