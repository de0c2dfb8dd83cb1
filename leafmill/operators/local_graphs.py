"""Graphs and trees of documents that lie whole in a task, for ``graphs``: Arrow batches sorted by ``doc`` in, batches out.

A task holds ``BLOCK`` rows of whole documents at a time, and one more document; its
caller sends no documents here that are too large for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: What a row of a graph says: an object is there, it leads to ``ref``, a walk begins at it.
THERE, LINK, ROOT = 0, 1, 2

Batches = Iterator[pa.RecordBatch]


def documents(batches: Batches) -> Iterator[pa.Table]:
    """Whole documents, ``BLOCK`` rows and up to one document more at a time; rows without one stand alone."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        docs = table.column("doc")
        cut = pc.index(docs, docs[-1]).as_py() if docs[-1].is_valid else size
        if cut:
            yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield pa.Table.from_batches(held)


class _Nodes:
    """Numbers, in the order of documents and objects, of the nodes that columns ``objects`` of a table name; -1 for none."""

    def __init__(self, table: pa.Table, *objects: str):
        docs = table.column("doc").combine_chunks().dictionary_encode()
        every = pa.chunked_array([c for name in objects for c in table.column(name).chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(every.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        held, own = (a.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for a in (docs, every))
        codes = np.where((own >= 0) & (np.tile(held, len(objects)) >= 0), np.tile(held, len(objects)) * len(order) + (place[own] if len(order) else 0), -1)
        known, found = np.unique(codes, return_inverse=True)
        none = int(len(known) > 0 and known[0] < 0)
        self.columns = np.split(found - none, len(objects))
        self.codes, self.width, self._order, self._docs, self._objects = known[none:], max(len(order), 1), order, docs.dictionary, every.dictionary

    def docs(self, nodes: np.ndarray) -> pa.Array:
        return self._docs.take(pa.array(self.codes[nodes] // self.width))

    def objects(self, nodes: np.ndarray) -> pa.Array:
        return self._objects.take(pa.array(self._order[self.codes[nodes] % self.width]))


def _reached(table: pa.Table, nodes: _Nodes, labels: list[str], apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of roots, nodes) of what each combination of labels reaches in each document; with ``apart`` no link to a root counts."""
    own, ref = nodes.columns
    kind = table.column("kind").to_numpy()
    roots = np.flatnonzero((kind == ROOT) & (own >= 0))
    links = np.flatnonzero((kind == LINK) & (own >= 0) & (ref >= 0))
    if apart:
        barred = np.zeros(len(nodes.codes), bool)
        barred[own[roots]] = True
        links = links[~barred[ref[links]]]
    links = links[np.argsort(own[links], kind="stable")]
    first = np.searchsorted(own[links], np.arange(len(nodes.codes) + 1)).tolist()
    to = ref[links].tolist()
    names = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[roots].tolist() for c in labels]
    walks: dict[tuple, tuple[int, set[int]]] = {}
    for row, doc, at, *label in zip(roots.tolist(), (nodes.codes[own[roots]] // nodes.width).tolist(), own[roots].tolist(), *names):
        walks.setdefault((doc, *label), (row, set()))[1].add(at)
    rows, found = [], []
    for row, seen in walks.values():
        stack = list(seen)
        while stack:
            at = stack.pop()
            for target in to[first[at] : first[at + 1]]:
                if target not in seen:
                    seen.add(target)
                    stack.append(target)
        rows += [row] * len(seen)
        found += seen
        if len(found) >= BLOCK:
            yield np.array(rows), np.array(found)
            rows, found = [], []
    if found:
        yield np.array(rows), np.array(found)


def _there(table: pa.Table, nodes: _Nodes) -> np.ndarray:
    own = nodes.columns[0]
    there = np.zeros(len(nodes.codes), bool)
    there[own[(table.column("kind").to_numpy() == THERE) & (own >= 0)]] = True
    return there


def reach(labels: list[str], apart: bool, known: bool) -> Callable[[Batches], Batches]:
    """``(labels, doc, object)`` of rows ``(kind, doc, object, ref, labels)``; with ``known`` only objects that are there."""

    def run(batches: Batches) -> Batches:
        for table in documents(batches):
            nodes = _Nodes(table, "object", "ref")
            there = _there(table, nodes) if known else None
            for rows, found in _reached(table, nodes, labels, apart):
                if known:
                    rows, found = rows[there[found]], found[there[found]]
                taken = [table.column(c).take(pa.array(rows)).combine_chunks() for c in labels]
                yield pa.RecordBatch.from_arrays([*taken, nodes.docs(found), nodes.objects(found)], names=[*labels, "doc", "object"])

    return run


def prune(references: bool) -> Callable[[Batches], Batches]:
    """Kept ``(doc, object, number)``, or their ``references (doc, number, place, target)``, of rows ``(kind, doc, object, ref, place)``."""

    def run(batches: Batches) -> Batches:
        for table in documents(batches):
            nodes = _Nodes(table, "object", "ref")
            kept = np.zeros(len(nodes.codes), bool)
            for _, found in _reached(table, nodes, [], False):
                kept[found] = True
            kept = np.flatnonzero(kept & _there(table, nodes))
            docs = nodes.codes[kept] // nodes.width
            number = np.zeros(len(nodes.codes) + 1, np.int64)  # the last for no node
            number[kept] = np.arange(len(kept)) - np.searchsorted(docs, docs) + 1
            if references:
                own, ref = nodes.columns
                rows = np.flatnonzero((table.column("kind").to_numpy() == LINK) & (own >= 0) & (number[own] > 0))
                target, place = number[ref[rows]], table.column("place").take(pa.array(rows)).combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.docs(own[rows]), pa.array(number[own[rows]]), place, pa.array(target, mask=target == 0)], names=["doc", "number", "place", "target"])
            else:
                yield pa.RecordBatch.from_arrays([nodes.docs(kept), nodes.objects(kept), pa.array(number[kept])], names=["doc", "object", "number"])

    return run


def _parents(table: pa.Table) -> np.ndarray:
    """The row of each row's parent, -1 for none that is known."""
    nodes = _Nodes(table, "node", "parent")
    own, above = nodes.columns
    row = np.full(len(nodes.codes) + 1, -1)
    row[own[own >= 0]] = np.flatnonzero(own >= 0)
    return row[above]


def inherit(limit: int) -> Callable[[Batches], Batches]:
    """``(doc, node, value, levels)`` of rows ``(doc, node, parent, value)``: ways up double their reach, as in ``graphs``."""

    def run(batches: Batches) -> Batches:
        for table in documents(batches):
            up, value = _parents(table), table.column("value").combine_chunks()
            source = np.where(value.is_valid().to_numpy(zero_copy_only=False), np.arange(len(up)), -1)
            levels, far = np.zeros(len(up), np.int64), np.ones(len(up), np.int64)
            for _ in range(limit.bit_length()):
                going = np.flatnonzero((source < 0) & (up >= 0))
                if not len(going):
                    break
                at = up[going]
                source[going], levels[going], far[going], up[going] = source[at], far[going] + levels[at], far[going] + far[at], up[at]
            none = (source < 0) | (levels > limit)
            columns = [table.column("doc").combine_chunks(), table.column("node").combine_chunks(), value.take(pa.array(source, mask=none)), pa.array(levels.astype(np.int32), mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "node", "value", "levels"])

    return run


def name(joint: str, limit: int) -> Callable[[Batches], Batches]:
    """``(doc, node, full, depth)`` of rows ``(doc, node, parent, name)``: level by level from the roots."""

    def run(batches: Batches) -> Batches:
        for table in documents(batches):
            up, names = _parents(table), table.column("name").to_pylist()
            full, depth = [None] * len(up), np.where(up < 0, 1, 0).astype(np.int32)
            order = np.argsort(up, kind="stable")
            first, last = (np.searchsorted(up[order], np.arange(len(up)), side) for side in ("left", "right"))
            level, here = 1, np.flatnonzero(up < 0)
            while len(here) and level <= limit:
                depth[here] = level
                for row, above in zip(here.tolist(), up[here].tolist()):
                    over = full[above] if above >= 0 else None
                    full[row] = over + joint + names[row] if over and names[row] else over or names[row] or None
                count = last[here] - first[here]
                here = order[np.repeat(first[here] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
                level += 1
            for at in range(0, len(up), BLOCK // 8):
                part = slice(at, at + BLOCK // 8)
                docs, own = (table.column(c).slice(at, BLOCK // 8).combine_chunks() for c in ("doc", "node"))
                yield pa.RecordBatch.from_arrays([docs, own, pa.array(full[part], pa.string()), pa.array(depth[part], mask=depth[part] == 0)], names=["doc", "node", "full", "depth"])

    return run
