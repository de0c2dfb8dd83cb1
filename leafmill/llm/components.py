"""Connected components of an edge table, by contraction.

Each round gives every node the least of itself and its neighbours as parent, shortens
the parent chains by jumps, and replaces edges by those between different roots.  All
joins read written tables on both sides, so a root with very many children is a
skewed partition that adaptive execution splits; minima are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _store


def _jumped(parents: DataFrame) -> DataFrame:
    """Parents of parents, again and again, until every parent is a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        further = _store.written(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
        moved = further.where("moved").limit(1).count()
        _store.drop(parents)
        parents = further.select("node", "parent")
        if not moved:
            return parents


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the least node of its component."""
    rows = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = _store.written(rows, "edges")
    total = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        roots = _jumped(_store.written(least, "parents"))
        if total is None:
            total = roots
        else:
            step = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            total = _store.written(total.join(step, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "roots")
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        further = left.join(a, "a").select("b", "root_a").join(b, "b").where("root_a <> root_b")
        further = _store.written(further.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        _store.drop(left)
        left = further
        if left.isEmpty():
            return total.select("node", F.col("parent").alias("root"))
