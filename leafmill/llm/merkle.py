"""Merkle manifest of a dataset: leaves, roots, and a proof for each row.

A row's leaf is the SHA-256 of its values.  In each group leaves ascend by key; eight
neighbours at a time become one node until one is left, the group's subroot, and the
subroots, ascending by group, become the root in the same way.

* Leaves are sorted by ranges, so a row's place follows from its place in its part and
  one offset a part; no task needs a whole group.
* Every 8^4 neighbours are a block, one row of a written table with a node above it.
  While more than ``top_nodes`` are left, those nodes are put into blocks again.
* The driver builds what is above (of at most ``top_nodes`` nodes) and broadcasts its
  levels, from which any suffix path is cut.  Executors finish the proofs block by
  block, and fold each row's leaf up its path.

Defined results: a null value, key or group counts as null (first in order), an empty
text as a value of no bytes; rows of equal keys ascend by leaf, so repeated rows are
leaves of their own, and which of them is which does not matter; a table of one row has
its leaf as root; an empty table gives no rows.  Any key and group types that sort will
do, and other columns of the table play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.llm import _store

FAN, HEIGHT = 8, 4
TOP_NODES = 1 << 16
_PATH = "array<struct<left:string,right:string>>"


def leaf(values: list[Column]) -> Column:
    """Digest of a row: for each value ``-`` if null, else its number of bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def digest(nodes: str) -> str:
    return hashlib.sha256(nodes.encode()).hexdigest()


def levels_of(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and ``height`` levels above them."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def height_above(block: int, n: int, most: int) -> int:
    """How many levels a block of ``n`` nodes gives: all unless it is the only one of its group."""
    if block:
        return most
    height = 0
    while n > 1:
        n, height = math.ceil(n / FAN), height + 1
    return height


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(left, right) neighbours of the i-th node and of its ancestors, below the last level."""
    path = []
    for level in levels[:-1]:
        run = i - i % FAN
        path.append(("".join(level[run:i]), "".join(level[i + 1 : run + FAN])))
        i //= FAN
    return path


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(f"{left}{node}{right}")
    return node


class Top:
    """The tree above at most ``top_nodes`` nodes ``(group, place, node)``."""

    def __init__(self, nodes: list[tuple[int, int, str]]):
        groups: dict[int, list[tuple[int, str]]] = {}
        for group, place, node in nodes:
            groups.setdefault(group, []).append((place, node))
        self.groups = {g: levels_of([n for _, n in sorted(own)], height_above(0, len(own), 0)) for g, own in groups.items()}
        self.subroots = levels_of([self.groups[g][-1][0] for g in sorted(groups)], height_above(0, len(groups), 0))
        self.place = {g: i for i, g in enumerate(sorted(groups))}

    def above(self, group: int, place: int) -> tuple[list[tuple[str, str]], str]:
        """The path from a node to the root, and its group's subroot."""
        return siblings(self.groups[group], place) + siblings(self.subroots, self.place[group]), self.groups[group][-1][0]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the part, the number of their group in it, and their place in that."""
    from pyspark import TaskContext

    part, number, place, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        numbers, places = [], []
        for group in batch.column("sort_group").to_pylist():
            if number < 0 or group != last:
                number, place, last = number + 1, 0, group
            numbers.append(number)
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(places), pa.int32()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), *batch.columns], names=["part", "number", "place", *batch.schema.names])


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``grp`` (the rank of its group) and ``pos`` (its place there), and the table that these are read from."""
    spark = leaves.sparkSession
    # equal rows are dealt to several parts by their number, which a repeated task gives again
    ranged = leaves.withColumn("nth", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(F.col("sort_group"), F.col("key"), F.col("leaf"), F.col("nth"))
    ranged = ranged.sortWithinPartitions("sort_group", "key", "leaf", "nth").drop("nth")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    numbered = _store.written(ranged.mapInArrow(_numbered, f"part int, number bigint, place bigint, {kinds}"), "merkle-leaves")
    edge = F.sha2(F.coalesce(F.concat(F.lit("="), F.col("sort_group").cast("string")), F.lit("-")), 256)
    parts = numbered.groupBy("part").agg(
        F.max("number").alias("last"),
        F.min_by(edge, "number").alias("first_group"),
        F.max_by(edge, "number").alias("last_group"),
        F.max(F.struct("number", "place")).getField("place").alias("last_place"),
    )
    offsets, rank, held, before = [], -1, 0, None
    for r in sorted(parts.collect(), key=lambda r: r.part):  # a row a part
        goes_on = rank >= 0 and r.first_group == before
        rank, start = (rank, held) if goes_on else (rank + 1, 0)
        offsets.append((r.part, rank, start))
        held = (start if r.last == 0 else 0) + r.last_place + 1
        rank, before = rank + r.last, r.last_group
    edges = F.broadcast(spark.createDataFrame(offsets, "part int, first_rank bigint, first_place bigint"))
    placed = numbered.join(edges, "part")
    grp, pos = F.col("first_rank") + F.col("number"), F.col("place") + F.when(F.col("number") == 0, F.col("first_place")).otherwise(0)
    return placed.select(grp.alias("grp"), pos.alias("pos"), "key", F.col("leaf").alias("node"), "claimed"), numbered


def _blocks(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """A row for each block: its ``members`` in order, and the node above them."""
    width = FAN**height
    members = F.sort_array(F.collect_list(F.struct(*(c for c in nodes.columns if c != "grp"))))
    gathered = nodes.groupBy("grp", F.floor(F.col("pos") / width).alias("block")).agg(members.alias("members"))

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at = _members(batch)
            roots = []
            for block, a, b in zip(batch.column("block").to_pylist(), at[:-1], at[1:]):
                roots.append(levels_of(nodes[a:b], height_above(block, b - a, height))[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "root"])

    return _store.written(gathered.mapInArrow(root, StructType([*gathered.schema, StructField("root", StringType())])), name)


def _members(batch: pa.RecordBatch) -> tuple[list[str], list[int]]:
    members = batch.column("members")
    return members.flatten().field("node").to_pylist(), [x - members.offsets[0].as_py() for x in members.offsets.to_pylist()]


def _with_paths(blocks: DataFrame, height: int, top=None) -> DataFrame:
    """(grp, pos) of each member with its path to the root and subroot; from the top, or from the blocks' own columns ``path`` and ``subroot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, members, batch, row in _finished(batches, height, top):
            levels, above, subroot = path
            paths = [[{"left": x, "right": y} for x, y in siblings(levels, i) + above] for i in range(len(levels[0]))]
            n = len(paths)
            columns = [pa.array([batch.column("grp")[row].as_py()] * n, pa.int64()), members.field("pos"), pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), pa.array([subroot] * n, pa.string()), pa.array(levels[0], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "pos", "path", "subroot", "node"])

    return blocks.mapInArrow(run, f"grp bigint, pos bigint, path {_PATH}, subroot string, node string")


def _finished(batches: Iterator[pa.RecordBatch], height: int, top):
    """For each block ``((its levels, the path above it, its subroot), members, batch, row)``."""
    for batch in batches:
        nodes, at = _members(batch)
        members = batch.column("members").flatten()
        for row, (grp, block, a, b) in enumerate(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist(), at[:-1], at[1:])):
            if top is not None:
                above, subroot = top.value.above(grp, block)
            else:
                above, subroot = [(x["left"], x["right"]) for x in batch.column("path")[row].as_py()], batch.column("subroot")[row].as_py()
            yield (levels_of(nodes[a:b], height_above(block, b - a, height)), above, subroot), members.slice(a, b - a), batch, row


def _proved(batches: Iterator[pa.RecordBatch], height: int, top, with_path: bool) -> Iterator[pa.RecordBatch]:
    for (levels, above, subroot), members, _, _ in _finished(batches, height, top):
        proofs, folded, paths = [], [], []
        for i, claimed in enumerate(members.field("claimed").to_pylist()):
            path = siblings(levels, i) + above
            proofs.append(digest("".join(x + y for x, y in path)))
            folded.append(fold(claimed, path))
            if with_path:
                paths.append([{"left": x, "right": y} for x, y in path])
        root = fold(levels[-1][0], above)
        n = len(proofs)
        columns = [members.field("key"), members.field("node"), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
        columns += [pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))] if with_path else []
        yield pa.RecordBatch.from_arrays(columns, names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["path"] * with_path)


def prove(docs: DataFrame, *, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: dict[str, Column] | None = None, with_path: bool = False, height: int = HEIGHT, top_nodes: int = TOP_NODES) -> DataFrame:
    """Each row's key, leaf, subroot, root, proof digest, the root its claimed values fold to, and whether that is the root.

    ``claimed`` names columns whose values are given by another expression than the
    manifest's own, as those of a copy that is to be checked; without it every row
    verifies.  ``with_path`` adds the proof itself, (left, right) siblings a level.
    """
    spark = docs.sparkSession
    own = {c: F.col(f"`{c}`") for c in columns}
    true, told = leaf(list(own.values())), leaf([(claimed or {}).get(c, own[c]) for c in columns])
    leaves = _store.written(docs.select(F.col(f"`{group}`").alias("sort_group"), F.col(f"`{key}`").alias("key"), true.alias("leaf"), told.alias("claimed")), "merkle-rows")
    placed, numbered = _placed(leaves)
    rounds = [_blocks(placed, height, "merkle-blocks")]  # each round's blocks; from `joined` on they are of subroots
    kind = leaves.schema["key"].dataType.simpleString()
    _store.drop(leaves, numbered)
    joined = None
    while rounds[-1].count() > top_nodes:
        nodes = rounds[-1].select("grp", F.col("block").alias("pos"), F.col("root").alias("node"))
        if joined is None and rounds[-1].where("block > 0").isEmpty():
            joined = len(rounds)
            nodes = nodes.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("pos"), "node")
        rounds.append(_blocks(nodes, height, "merkle-blocks"))
    top = spark.sparkContext.broadcast(Top([(r.grp, r.block, r.root) for r in rounds[-1].select("grp", "block", "root").collect()]))
    blocks, source = rounds[-1], top
    for number in reversed(range(1, len(rounds))):
        paths = _with_paths(blocks, height, source).withColumnRenamed("pos", "block")
        if number == joined:  # a subroot's place is its group's rank
            paths = paths.select(F.col("block").alias("grp"), F.lit(0).cast("bigint").alias("block"), "path", F.col("node").alias("subroot"))
        blocks, source = rounds[number - 1].join(paths.drop("node"), ["grp", "block"]), None
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + f", path {_PATH}" * with_path
    made = blocks.mapInArrow(partial(_proved, height=height, top=source, with_path=with_path), schema)
    return made.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)
