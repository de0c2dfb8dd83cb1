"""Graphs and trees of a document's objects, as tables of edges and of parents.

Nodes are rows ``(doc, object)``.  Documents of up to ``WHOLE`` rows are shuffled once, by
document, and walked where they lie (``local_graphs``).  A larger one is dealt over many
tasks: what can be reached is found frontier by frontier, where each round takes several
hops, keeps what is new, and is written, so a lost executor costs a round at most.  Ways up
a tree are halved round by round: each node points at its parent, then at its grandparent,
then four levels up, so a hundred levels take seven rounds.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators import local_graphs
from leafmill.operators.batches import ranked
from leafmill.sources.tables import written

#: Rows of a document that one task takes whole (some 200 MB), and classes of documents whose rows are counted first.
WHOLE, CLASSES = 1 << 20, 4096


def _parted(rows: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of documents of up to ``whole`` rows, dealt and sorted by ``doc``; ``(doc)`` of the larger ones, or None).

    A large document makes its class large, so documents are counted in such classes alone.
    """
    own = F.pmod(F.xxhash64("doc"), F.lit(CLASSES))
    named = rows.where("doc is not null").select("doc")
    full = [r.own for r in named.groupBy(own.alias("own")).count().where(F.col("count") > whole).collect()]
    large = written(named.where(own.isin(full)).groupBy("doc").count().where(F.col("count") > whole).select("doc"), "graph-large") if full else None
    if large is None or large.isEmpty():
        return rows.repartition("doc").sortWithinPartitions("doc"), None
    return rows.join(large, "doc", "left_anti").repartition("doc").sortWithinPartitions("doc"), large


def _graph(edges: DataFrame, roots: DataFrame, objects: DataFrame | None, labels: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(kind, doc, object, ref, place, labels)`` of all that is said about a graph."""
    kinds = [(local_graphs.LINK, edges, ["ref", *(["place"] if "place" in edges.columns else [])]), (local_graphs.ROOT, roots, list(labels))]
    kinds += [] if objects is None else [(local_graphs.THERE, objects, [])]
    parts = [rows.select(F.lit(kind).alias("kind"), "doc", "object", *more) for kind, rows, more in kinds]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _ddl(rows: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def reachable(edges: DataFrame, roots: DataFrame, *, labels: tuple[str, ...] = (), objects: DataFrame | None = None, apart: bool = False, hops: int = 4, whole: int = WHOLE) -> DataFrame:
    """``(labels, doc, object)`` that ``roots`` of that form lead to over ``edges (doc, object, ref)``, each once.

    Roots are in it.  Each combination of ``labels`` walks for itself.  Nulls lead
    nowhere; loops, repeated edges and edges to unknown objects do no harm.  Of what is
    found only ``objects (doc, object)`` count, if given.  With ``apart`` no way leads to a root.
    """
    rows = _graph(edges, roots, objects, labels)
    near, large = _parted(rows, whole)
    found = near.mapInArrow(local_graphs.reach(list(labels), apart, objects is not None), _ddl(rows, *labels, "doc", "object"))
    if large is None:
        return found
    starts = roots.join(large, "doc", "left_semi")
    links = edges.select("doc", "object", "ref").join(large, "doc", "left_semi")
    if apart:
        links = links.join(starts.select("doc", F.col("object").alias("ref")).distinct(), ["doc", "ref"], "left_anti")
    far = _frontiers(links, starts, labels, hops)
    return found.unionByName(far if objects is None else far.join(objects.select("doc", "object").distinct(), ["doc", "object"], "left_semi"))


def _frontiers(edges: DataFrame, roots: DataFrame, labels: tuple[str, ...] = (), hops: int = 4) -> DataFrame:
    """What is ``reachable``, frontier by frontier."""
    place = [*labels, "doc", "object"]
    known = written(edges.select("doc", "object", "ref").where("doc is not null and object is not null and ref is not null").distinct(), "graph-edges")
    found = [written(roots.select(*place).where("doc is not null and object is not null").distinct(), "graph-roots")]
    frontier = found[0]
    while True:
        steps, here = [], frontier
        for hop in range(1, hops + 1):
            here = here.join(known, ["doc", "object"]).select(*labels, "doc", F.col("ref").alias("object")).distinct()
            steps.append(here.withColumn("hop", F.lit(hop)))
        first = reduce(DataFrame.union, steps).groupBy(*place).agg(F.min("hop").alias("hop"))
        seen = reduce(DataFrame.union, [f.select(*place) for f in found])
        new = written(_without(first, seen, place), "graph-frontier")
        if new.isEmpty():
            return seen
        found = [*found, new] if len(found) < 8 else [written(seen, "graph-seen"), new]
        frontier = new.where(F.col("hop") == hops).select(*place)  # the others have been followed already


def _without(rows: DataFrame, others: DataFrame, place: list[str]) -> DataFrame:
    """Null labels are equal to each other."""
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place])
    return rows.alias("a").join(others.alias("b"), same, "left_anti")


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Rows with their place (from 1) in their ``doc``, by an order that tells all of a document's rows apart."""
    placed = written(ranked(rows, [F.col("doc"), *order], "__place"), "graph-places")
    first = placed.groupBy("doc").agg(F.min("__place").alias("__first"))
    return placed.join(first, "doc").withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def pruned(objects: DataFrame, edges: DataFrame, roots: DataFrame, *, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(kept ``(doc, object, number)``, their references ``(doc, number, place, target)``).

    Kept are the ``objects (doc, object)`` that ``roots`` lead to, numbered from 1 in
    each document by their old numbers.  ``edges (doc, object, place, ref)`` of kept
    objects point at new numbers; those to objects that are unknown point at null.
    """
    rows = _graph(edges, roots, objects)
    near, large = _parted(rows, whole)
    found = near.mapInArrow(local_graphs.prune(False), _ddl(rows, "doc", "object") + ", number bigint")
    pointed = near.mapInArrow(local_graphs.prune(True), f"{_ddl(rows, 'doc')}, number bigint, {_ddl(rows, 'place')}, target bigint")
    if large is None:
        return found, pointed
    edges = edges.join(large, "doc", "left_semi")
    kept = _frontiers(edges, roots.join(large, "doc", "left_semi")).join(objects.select("doc", "object").distinct(), ["doc", "object"], "left_semi")
    kept = written(numbered(kept, [F.col("object")]), "graph-kept").select("doc", "object", "number")
    targets = kept.select("doc", F.col("object").alias("ref"), F.col("number").alias("target"))
    references = edges.select("doc", "object", "place", "ref").join(kept, ["doc", "object"]).join(targets, ["doc", "ref"], "left")
    return found.unionByName(kept), pointed.unionByName(references.select("doc", "number", "place", "target"))


def page_objects(objects: DataFrame, edges: DataFrame, pages: DataFrame, *, whole: int = WHOLE) -> DataFrame:
    """``(page, doc, object)`` of what each of ``pages (doc, object)`` needs to stand alone: no way leads through another page."""
    return reachable(edges, pages.select("doc", "object", F.col("object").alias("page")), labels=("page",), objects=objects, apart=True, whole=whole)


def _climbed(nodes: DataFrame, merged: dict[str, Column], rounds: int, going: Column) -> DataFrame:
    """``rounds`` times, rows ``(doc, node, up, ...)`` that are still ``going`` take in what stands at ``up`` (columns ``at_*``) and point where that points."""
    state = written(nodes, "tree")
    for _ in range(rounds):
        moving = state.where(F.col("up").isNotNull() & going)
        if moving.isEmpty():
            break
        above = state.select("doc", F.col("node").alias("up"), F.col("up").alias("at_up"), *(F.col(c).alias(f"at_{c}") for c in merged))
        moved = moving.join(above, ["doc", "up"], "left").select("doc", "node", F.col("at_up").alias("up"), *(v.alias(c) for c, v in merged.items()))
        still = state.where(~F.coalesce(F.col("up").isNotNull() & going, F.lit(False))).select("doc", "node", "up", *merged)
        state = written(still.unionByName(moved), "tree")
    return state


def inherited(nodes: DataFrame, *, limit: int = 100, whole: int = WHOLE) -> DataFrame:
    """``(doc, node, value, levels)``: the value of ``nodes (doc, node, parent, value)`` or of the nearest ancestor that has one, and how far up it is.

    Ancestors over ``limit`` levels up do not count, so a loop of parents ends; a parent
    that is unknown ends the way.  A node must be named once in a document.
    """
    near, large = _parted(nodes.select("doc", "node", "parent", "value"), whole)
    found = near.mapInArrow(local_graphs.inherit(limit), _ddl(nodes, "doc", "node", "value") + ", levels int")
    if large is None:
        return found
    nodes = nodes.join(large, "doc", "left_semi")
    rows = nodes.select("doc", "node", F.col("parent").alias("up"), "value", F.when(F.col("value").isNotNull(), 0).cast("int").alias("levels"), F.lit(1).alias("far"))
    merged = {"value": F.col("at_value"), "levels": F.col("far") + F.col("at_levels"), "far": F.col("far") + F.col("at_far")}
    done = _climbed(rows, merged, math.ceil(math.log2(limit + 1)), F.col("value").isNull())
    close = F.col("levels") <= limit
    return found.unionByName(done.select("doc", "node", F.when(close, F.col("value")).alias("value"), F.when(close, F.col("levels")).alias("levels")))


def full_names(nodes: DataFrame, *, joint: str = ".", limit: int = 32, whole: int = WHOLE) -> DataFrame:
    """``(doc, node, full, depth)``: the names of a node's ancestors and its own with ``joint`` between, and its level (a root: 1).

    Nodes with no or an empty name add nothing.  Deeper than ``limit`` levels (as in a loop of
    parents) both are null; a parent that is unknown ends the way.
    """
    near, large = _parted(nodes.select("doc", "node", "parent", "name"), whole)
    found = near.mapInArrow(local_graphs.name(joint, limit), _ddl(nodes, "doc", "node") + ", full string, depth int")
    if large is None:
        return found
    nodes = nodes.join(large, "doc", "left_semi")
    rows = nodes.select("doc", "node", F.col("parent").alias("up"), F.nullif(F.col("name"), F.lit("")).alias("full"), F.lit(1).alias("depth"))
    merged = {
        "full": F.nullif(F.concat_ws(joint, F.col("at_full"), F.col("full")), F.lit("")),
        "depth": F.col("depth") + F.coalesce(F.col("at_depth"), F.lit(0)),
    }
    # after k rounds a way of 2^k levels is walked; what still goes on, or went further, is too deep
    done = _climbed(rows, merged, math.ceil(math.log2(limit)) + 1, F.col("depth") <= limit)
    ended = F.col("up").isNull() & (F.col("depth") <= limit)
    return found.unionByName(done.select("doc", "node", F.when(ended, F.col("full")).alias("full"), F.when(ended, F.col("depth")).alias("depth")))
