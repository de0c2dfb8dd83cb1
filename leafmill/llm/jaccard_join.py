"""N-gram Jaccard self-join: a MinHash LSH forest, then exact verification.

Documents are sets of five-word shingles; those with the same words are one class, and
only one text of each class is joined.  A signature is ``trees`` tries of ``max_depth``
MinHash values.  Two texts are candidates where a tree gives both a prefix that either
of them asks for.  Every text asks for a prefix in each tree, and starts at full depth:

1. all its prefixes are shortened together until the chance to meet a text at the
   threshold, ``1 - prod(1 - threshold ** depth)``, reaches ``target_recall``;
2. prefixes that over ``crowded`` texts share are left as long as that takes to be under it;
3. the chance that this costs is won back: the other trees are shortened further (to
   ``shortest`` at least), then the crowded ones, the least crowded first, until the
   text's chance is at the target again.

So lengths follow the data, and every text meets the target.  Only crowding counts, not
emptiness: shortening where nothing is found would bias the chance just computed.

Pairs whose signatures agree too little (four standard errors under the threshold) are
no candidates.  Components of candidates are verified on the shingle sets themselves,
which gives exact links.

Groups (buckets and components) above a block size are cut into blocks by hash.  A row
is shuffled once, to its block, which compares its own rows and, where there are more
blocks, writes them as a file in the shared folder; pairs of blocks are then read from
those files in strips.  So shuffles grow with the rows, though all pairs of a component
are compared, and tasks return counts and spanning edges, not pairs.  Only links that
no tree brings together are lost: the recall above, measured in the tests.

Defined results: a text of one to four words is one shingle; a text without words, or a
row with a null key, is a class of its own without links; repeated rows are copies, rows
of one key with unlike texts are texts of their own; links at exactly the threshold
count; keys must be whole numbers or text of such, others count as null.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _store, _text
from leafmill.llm.components import connected

SHINGLE = 5
_BLOCK, _BLOCK_SHINGLES, _STRIP = 256, 1 << 18, 32


def prefix_depth(trees: int, max_depth: int, threshold: float, target_recall: float) -> int:
    """The longest prefix with which a pair at the threshold is found with the wanted probability."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target_recall:
        depth -= 1
    return depth


def shingle_hashes(words: _text.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each row (in order, repeats kept) and the rows' pointers; a shorter text is one shingle."""
    codes = words.hashes()
    counts = np.diff(words.first)
    windows = _text.window_hashes(codes, size)[_text.windows_of(words.first, len(codes), size)]
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    pointers = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(pointers[-1]), dtype=np.uint64)
    short = (counts > 0) & (counts < size)
    owner_short = np.repeat(short, n)
    out[~owner_short] = windows
    for i in np.flatnonzero(short).tolist():
        own = codes[words.first[i] : words.first[i + 1]]
        out[pointers[i]] = _text.window_hashes(own, len(own))[0]
    return out, pointers


def signatures(codes: np.ndarray, pointers: np.ndarray, n_hashes: int) -> np.ndarray:
    """16-bit MinHash values (rows, n_hashes); rows without shingles are 0."""
    rng = np.random.default_rng(5081)
    factor = rng.integers(0, 1 << 31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)
    low = (codes >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(pointers) - 1, n_hashes), dtype=np.uint16)
    full = np.flatnonzero(np.diff(pointers) > 0)
    if len(full):
        starts = pointers[:-1][full]
        for k in range(n_hashes):
            least = np.minimum.reduceat(low * factor[k] + shift[k], starts)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sequence_hashes(words: _text.Words) -> np.ndarray:
    """Two 64-bit hashes of the word sequence of each row."""
    codes = words.hashes()
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(words.first[:-1], np.diff(words.first)).astype(np.uint64)
    out = np.zeros((len(words.first) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(words.first) > 0)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
        if len(full):
            out[full, k] = np.add.reduceat(_text.mix(codes + (place + np.uint64(k)) * np.uint64(factor)), words.first[:-1][full])
    return out.view(np.int64)


def sign(docs: DataFrame, key: str, text: str, trees: int, max_depth: int) -> DataFrame:
    """``(key, h1, h2, n_shingles, sig)``; ``sig`` is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                words = _text.Words(part.column("text"))
                codes, pointers = shingle_hashes(words)
                own = signatures(codes, pointers, trees * max_depth)
                hashes = _sequence_hashes(words)
                sigs = [s.tobytes() if n else None for s, n in zip(own, np.diff(pointers).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(np.diff(pointers), pa.int64()), pa.array(sigs, pa.binary())], names=["key", "h1", "h2", "n_shingles", "sig"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "key bigint, h1 bigint, h2 bigint, n_shingles bigint, sig binary")


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """The rows of each unit; their first ``n_keys`` columns are its key, and the input is sorted by it."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, unit in groupby(rows, key=itemgetter(*range(n_keys))):
        yield list(unit)


def _save(folder: str, group: int, block: int, **arrays: np.ndarray) -> None:
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    fs, root = _store.filesystem(folder)
    _store.put_file(fs, f"{root}/{group}-{block}.npz", raw.getvalue())


def _load(folder: str, group: int, block: int) -> dict[str, np.ndarray]:
    fs, root = _store.filesystem(folder)
    with fs.open_input_file(f"{root}/{group}-{block}.npz") as source:
        return dict(np.load(io.BytesIO(source.read())))


def _strips(rows: DataFrame) -> DataFrame:
    """``(group, i, others)``: each block that has rows, of groups of more than one, against strips of all blocks of its group."""
    found = rows.where("blocks > 1").select("group", "b").distinct().groupBy("group").agg(F.sort_array(F.collect_list("b")).alias("all"))
    own = found.where(F.size("all") > 1).select("group", "all", F.explode("all").alias("i"))
    starts = F.sequence(F.lit(1), F.size("all"), F.lit(_STRIP))
    return own.select("group", "i", F.explode(F.transform(starts, lambda x: F.slice("all", x, _STRIP))).alias("others"))


def _labels(near: np.ndarray) -> np.ndarray:
    """Component (least row number) of each row of a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def agreeing(a: np.ndarray, b: np.ndarray, least_equal: int) -> np.ndarray:
    """Which rows of two signature matrices agree in enough places."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    step = max(1, (1 << 22) // (b.size + 1))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] == b[None, :, :]).sum(axis=2) >= least_equal
    return out


def trie_forest(sigs: np.ndarray, paths: list[bytes], depth: int, max_depth: int, least_equal: int) -> np.ndarray:
    """Component (row number of a member) of each of one unit's rows, deepest shared prefixes first."""
    order = np.array(sorted(range(len(paths)), key=paths.__getitem__))
    sigs = sigs[order]
    label = np.arange(len(order))
    for level in range(max_depth, depth, -1):
        same = np.array([paths[a][: 2 * level] == paths[b][: 2 * level] for a, b in zip(order[:-1].tolist(), order[1:].tolist())], dtype=bool)
        close = same & ((sigs[1:] == sigs[:-1]).sum(axis=1) >= least_equal)
        label = np.cumsum(np.concatenate([[0], ~close]))
        if not label[-1]:
            break  # all united below the prefix
    joined = label[:, None] == label[None, :]
    if label[-1]:
        joined |= agreeing(sigs, sigs, least_equal)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[_labels(joined)]
    return out


def chosen_depths(sizes: np.ndarray, shortest: int, threshold: float, target_recall: float, crowded: int) -> np.ndarray:
    """Prefix length of each text in each tree, from ``sizes`` (texts, trees, levels): how many texts share its prefix of ``shortest``, ... values."""
    n, trees, levels = sizes.shape
    max_depth = shortest + levels - 1
    gain = -np.log1p(-(threshold ** np.arange(shortest, max_depth + 1, dtype=np.float64)))  # by level
    need = -math.log1p(-target_recall)
    base = max(prefix_depth(trees, max_depth, threshold, target_recall), shortest) - shortest
    uncrowded = np.where((sizes <= crowded).any(axis=2), (sizes <= crowded).argmax(axis=2), levels - 1)  # sizes fall with the level
    depth = np.maximum(base, uncrowded)
    rest = uncrowded <= base
    while True:  # the trees that are not crowded, all together
        short = gain[depth].sum(axis=1) < need
        lower = short[:, None] & rest & (depth > 0) & (np.maximum(depth - 1, 0) >= uncrowded)
        if not lower.any():
            break
        depth = depth - lower
    while True:
        short = np.flatnonzero((gain[depth].sum(axis=1) < need) & (depth > 0).any(axis=1))
        if not len(short):
            return depth + shortest
        below = np.take_along_axis(sizes[short], np.maximum(depth[short] - 1, 0)[:, :, None], axis=2)[:, :, 0].astype(np.float64)
        below[depth[short] == 0] = np.inf
        depth[short, below.argmin(axis=1)] -= 1


def _prefix(tree: Column, level: Column, max_depth: int) -> Column:
    return F.xxhash64(tree, level, F.substring(F.col("sig"), tree * 2 * max_depth + 1, 2 * level))


def asked_buckets(reps: DataFrame, *, trees: int, max_depth: int, shortest: int, threshold: float, target_recall: float, crowded: int) -> DataFrame:
    """``(bucket, n, tree, level, node)``: the members of every prefix that some text asks for and shares with another."""
    levels = F.array(*[F.lit(x) for x in range(shortest, max_depth + 1)])
    # Joins are merge joins at every size, so that the plan of a small table is that of a large one.
    spread = reps.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    roots = spread.select("node", "tree", _prefix(F.col("tree"), F.lit(shortest), max_depth).alias("root"))
    shared = _store.written(roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "roots")
    narrow = _store.written(roots.join(shared.hint("merge"), "root").select("node", "tree"), "shared-roots")
    signed = narrow.join(reps.select("node", "sig").hint("merge"), "node")
    deeper = signed.select("node", "tree", "sig", F.explode(levels).alias("level")).select("node", "tree", "level", _prefix(F.col("tree"), F.col("level"), max_depth).alias("bucket"))
    deeper = _store.written(deeper, "prefixes")
    counts = _store.written(deeper.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = _store.written(deeper.join(counts.hint("merge"), "bucket"), "shared-prefixes")
    held = members.groupBy("node").agg(F.collect_list(F.struct("tree", "level", "n", "bucket")).alias("held"))  # trees x levels at most

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("held")
            flat = lists.flatten()
            tree, level, n, bucket = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            sizes = np.ones((len(lists), trees, max_depth - shortest + 1), dtype=np.int64)
            sizes[owner, tree, level - shortest] = n
            depth = chosen_depths(sizes, shortest, threshold, target_recall, crowded)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bucket[level == depth[owner, tree]]), pa.int64())], names=["bucket"])

    asked = _store.written(held.select("held").mapInArrow(choose, "bucket bigint").distinct(), "asked")
    found = members.join(asked.hint("merge"), "bucket", "left_semi")
    return found.select("bucket", "n", "tree", "level", "node")


def candidate_edges(reps: DataFrame, *, trees: int, max_depth: int, shortest: int, threshold: float, target_recall: float, crowded: int, block: int) -> DataFrame:
    """Spanning edges ``(a, b)`` of the candidate graph of ``reps`` (``node``, ``sig``)."""
    n_hashes = trees * max_depth
    least_equal = math.floor(n_hashes * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / n_hashes)))
    members = asked_buckets(reps, trees=trees, max_depth=max_depth, shortest=shortest, threshold=threshold, target_recall=target_recall, crowded=crowded)
    blocks = F.ceil(F.col("n") / block)
    members = _store.written(members.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks"))).drop("n"), "asked-prefixes")
    signed = members.join(reps.select("node", "sig").hint("merge"), "node").select("bucket", "b", "blocks", "tree", "level", "node", "sig")
    folder = _store.new_folder(reps.sparkSession, "bucket-blocks")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for unit in _grouped(batches, 2):
            sigs = np.frombuffer(b"".join(r[6] for r in unit), "<u2").reshape(len(unit), -1)
            at = unit[0][3] * 2 * max_depth
            label = trie_forest(sigs, [r[6][at : at + 2 * max_depth] for r in unit], unit[0][4], max_depth, least_equal) if len(unit) > 1 else np.zeros(1, np.int64)
            nodes = [r[5] for r in unit]
            edges += [(nodes[i], nodes[int(label[i])]) for i in np.flatnonzero(label != np.arange(len(unit))).tolist()]
            if unit[0][2] > 1:
                _save(folder, unit[0][0], unit[0][1], sigs=sigs, nodes=np.array(nodes, np.int64), label=label)
            if len(edges) > 50_000:
                yield _edges(edges)
        yield _edges(edges)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group, i, others in _strip_rows(batches):
            a = _load(folder, group, i)
            for j in (j for j in others if j > i):
                edges += block_edges(a, _load(folder, group, j), least_equal)
            if len(edges) > 50_000:
                yield _edges(edges)
        yield _edges(edges)

    first = _store.written(signed.repartition("bucket", "b").sortWithinPartitions("bucket", "b").mapInArrow(own, "a bigint, b bigint"), "candidates")
    strips = _strips(members.withColumnRenamed("bucket", "group")).where(F.element_at("others", -1) > F.col("i"))
    pairs = strips.repartition("group", "i", F.col("others")[0]).mapInArrow(across, "a bigint, b bigint")
    return first.unionByName(pairs)


def block_edges(a: dict[str, np.ndarray], b: dict[str, np.ndarray], least_equal: int) -> list[tuple[int, int]]:
    """Edges that unite the components of two blocks wherever a row of one agrees with a row of the other."""
    heads = [np.unique(x["label"]) for x in (a, b)]
    met = agreeing(a["sigs"][heads[0]], b["sigs"][heads[1]], least_equal)
    if not met.all():  # heads that do not agree may have members that do
        rows, cols = (np.searchsorted(h, x["label"]) for h, x in zip(heads, (a, b)))
        for k in np.flatnonzero(~met.all(axis=1)).tolist():
            left = ~met[k][cols]
            found = agreeing(a["sigs"][rows == k], b["sigs"][left], least_equal).any(axis=0)
            met[k, np.unique(cols[left][found])] = True
    return [(int(a["nodes"][heads[0][i]]), int(b["nodes"][heads[1][j]])) for i, j in zip(*np.nonzero(met))]


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
    edges.clear()
    return batch


def _strip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int]]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("group", "i", "others")))


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, or with ``others``, by blocks of a matrix product."""
    every = sets + (others or [])
    column = np.unique(np.concatenate(every), return_inverse=True)[1]
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    seen = np.bincount(column)
    place = np.cumsum(seen > 1) - 1
    kept = seen[column] > 1
    row, column = row[kept], place[column[kept]]
    n = len(sets)
    out = np.zeros((n, len(every) - n if others else n), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(every), width), dtype=np.float32)
        dense[row[a:b], column[a:b] - start] = 1
        out += dense[:n] @ (dense[n:] if others else dense).T
    if not others:
        np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _near(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    a, b = (np.array([len(s) for s in x], dtype=np.float64) for x in (sets, others or sets))
    common = intersections(sets, others)
    return common >= threshold * (a[:, None] + b[None, :] - common) - 1e-9


def _counts(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "texts", "docs", "root"])


_COUNTS = "node bigint, texts bigint, docs bigint, root bigint"


def verified_links(shingled: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """``(node, texts, docs, root)`` to be summed by node, with edges ``node`` to ``root``, of all pairs in each group.

    ``shingled`` has ``group, b, blocks, node, copies, set``; ``members`` the first three.
    """
    folder = _store.new_folder(shingled.sparkSession, "set-blocks")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for unit in _grouped(batches, 2):
            unit = list({r[3]: r for r in unit}.values())  # rows of one class are one text
            sets, nodes, copies = [np.frombuffer(r[5], "<u8") for r in unit], [r[3] for r in unit], np.array([r[4] for r in unit])
            label = np.zeros(len(unit), np.int64)
            if len(unit) > 1:
                near = _near(sets, None, threshold)
                np.fill_diagonal(near, False)
                label = _labels(near)
                made += [(v, int(t), int(d), nodes[int(x)]) for v, t, d, x in zip(nodes, near.sum(axis=1), near @ copies, label) if t]
            if unit[0][2] > 1:
                _save(folder, unit[0][0], unit[0][1], nodes=np.array(nodes, np.int64), copies=copies, label=label, sizes=np.array([len(x) for x in sets]), sets=np.concatenate(sets))
            if len(made) > 50_000:
                yield _counts(made)
        yield _counts(made)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        split = lambda x: np.split(x["sets"], np.cumsum(x["sizes"])[:-1])
        for group, i, others in _strip_rows(batches):
            a = _load(folder, group, i)
            sets = split(a)
            texts, docs = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            for j in (j for j in others if j != i):
                b = _load(folder, group, j)
                near = _near(sets, split(b), threshold)
                texts += near.sum(axis=1)
                docs += near @ b["copies"]
                if j > i:
                    met = np.unique(np.stack([a["label"][np.nonzero(near)[0]], b["label"][np.nonzero(near)[1]]]), axis=1)
                    made += [(int(a["nodes"][x]), 0, 0, int(b["nodes"][y])) for x, y in met.T.tolist()]
            made += [(v, t, d, v) for v, t, d in zip(a["nodes"].tolist(), texts.tolist(), docs.tolist()) if t]
            if len(made) > 50_000:
                yield _counts(made)
        yield _counts(made)

    first = _store.written(shingled.select("group", "b", "blocks", "node", "copies", "set").repartition("group", "b").sortWithinPartitions("group", "b").mapInArrow(own, _COUNTS), "links-in-blocks")
    return first.unionByName(_strips(members).repartition("group", "i", F.col("others")[0]).mapInArrow(across, _COUNTS))


def _classes(docs: DataFrame, key: str, text: str, threshold: float, trees: int, max_depth: int, shortest: int, target_recall: float, crowded: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows ``(key, h1, h2, sig)``, and for each class of equal words ``(h1, h2)`` its linked group, least key, links, copies and ``class_id``."""
    signed = _store.written(sign(docs, key, text, trees, max_depth), "signatures")
    grouped = signed.where("sig is not null and key is not null").groupBy("h1", "h2").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = _store.written(grouped.withColumn("node", F.monotonically_increasing_id()), "representatives")  # numbers that are fixed once written
    edges = candidate_edges(reps, trees=trees, max_depth=max_depth, shortest=shortest, threshold=threshold, target_recall=target_recall, crowded=crowded, block=block)
    groups = connected(edges).withColumnRenamed("root", "group")
    members = _store.written(groups.join(reps.select("node", "h1", "h2", "least", "copies", "n_shingles"), "node"), "members")
    sizes = _store.written(members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / _BLOCK_SHINGLES)).alias("blocks")), "sizes")
    sized = members.join(sizes, "group").select("group", "node", "h1", "h2", "least", "copies", "blocks").withColumn("b", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")))
    sized = _store.written(sized, "sized")
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("least"), F.col(f"`{text}`").cast("string").alias("text")).join(sized.hint("merge"), "least")

    kept = ("group", "b", "blocks", "node", "copies")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                words = _text.Words(part.column("text"))
                hashes = _sequence_hashes(words)
                own = np.flatnonzero((hashes[:, 0] == part.column("h1").to_numpy()) & (hashes[:, 1] == part.column("h2").to_numpy()))  # not another text of this key
                codes, pointers = shingle_hashes(words)
                made = [np.unique(codes[pointers[i] : pointers[i + 1]]).tobytes() for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(own)) for c in kept), pa.array(made, pa.binary())], names=[*kept, "set"])

    shingled = texts.mapInArrow(sets, ", ".join(f"{c} bigint" for c in kept) + ", set binary")
    verified = _store.written(verified_links(shingled, sized, threshold), "verified")
    counts = verified.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = _store.written(connected(verified.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(reps.select("node", "least"), "node"), "linked")
    least = roots.groupBy("root").agg(F.min("least").alias("class_id"))
    least = _store.written(least, "class-ids")
    named = roots.join(least, "root").select("node", "root", "class_id")
    classes = reps.select("h1", "h2", "node", "least", "copies").join(counts, "node", "left").join(named, "node", "left")
    classes = classes.select("h1", "h2", F.coalesce("root", "node").alias("group"), F.coalesce("class_id", "least").alias("class_id"), "least", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), F.col("copies").alias("n_copies"))
    classes = _store.written(classes, "classes")
    _store.drop(reps, members, sizes, sized, verified, roots, least)
    return signed, classes


def linked(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, trees: int = 16, max_depth: int = 6, shortest: int = 3, target_recall: float = 0.999, crowded: int = 64, block: int = _BLOCK
) -> DataFrame:
    """One row per row of ``docs``: key, ``class_id`` (least key of its linked group), ``n_links`` (other documents
    at or above the threshold), ``n_text_links`` (other texts), ``n_copies`` (documents with the same words).

    The key column comes out as ``key`` if it is called like an added one.
    """
    signed, classes = _classes(docs, key, text, threshold, trees, max_depth, shortest, target_recall, crowded, block)
    found = signed.select("key", F.when(F.col("sig").isNotNull() & F.col("key").isNotNull(), F.col("h1")).alias("h1"), "h2").join(classes.drop("least", "group"), ["h1", "h2"], "left")
    zero = lambda c, other: F.coalesce(F.col(c), F.lit(other).cast("bigint")).alias(c)
    name = "key" if key in ("class_id", "n_links", "n_text_links", "n_copies") else key
    return found.select(F.col("key").alias(name), F.coalesce("class_id", "key").alias("class_id"), zero("n_links", 0), zero("n_text_links", 0), zero("n_copies", 1))


def one_of_each(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, trees: int = 16, max_depth: int = 6, shortest: int = 3, target_recall: float = 0.999, crowded: int = 64, block: int = _BLOCK
) -> DataFrame:
    """``docs`` with one row of each linked group: of its rows with the least key one text, and of repeated rows one.

    Rows with a null key or without words all stay.
    """
    signed, classes = _classes(docs, key, text, threshold, trees, max_depth, shortest, target_recall, crowded, block)
    own = classes.where("least = class_id")
    own = own.join(own.groupBy("group").agg(F.min(F.struct("h1", "h2")).alias("one")), "group").where("h1 = one.h1 and h2 = one.h2")
    rows = signed.where("key is not null and sig is not null").join(own.select("h1", "h2", F.col("least").alias("key")), ["h1", "h2", "key"])
    kept = rows.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"))
    kept = _store.written(kept.select(F.col("key").alias("__key"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("n").alias("__n")), "kept-rows")

    def made(texts: pa.Array) -> list[pa.Array]:
        words = _text.Words(texts)
        hashes = _sequence_hashes(words)
        return [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(np.diff(words.first) > 0)]

    hashed = _text.appended(docs, made, {"__hash": "long", "__other_hash": "long", "__words": "boolean"}, text)
    known = F.col("__words") & F.col(f"`{key}`").cast("bigint").isNotNull()
    marked = hashed.join(kept, known & (F.col(f"`{key}`").cast("bigint") == F.col("__key")) & (F.col("__hash") == F.col("__h1")) & (F.col("__other_hash") == F.col("__h2")), "left")
    single = marked.where(~known | (F.col("__n") == 1))
    repeated = marked.where(known & (F.col("__n") > 1)).dropDuplicates(["__key", "__h1", "__h2"])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
