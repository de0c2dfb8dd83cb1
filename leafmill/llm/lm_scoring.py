"""Language-model scoring by cross-entropy difference of two word 3-gram models.

Tokens are words, hashed to one vocabulary of ``2 ** BITS`` ids that both models share.
The target model is counted on the target texts and the background model on all
others, so no text is in both; the counts of the larger side are weighted so that both
have the same mass.  Probabilities are interpolated from the highest order down
(Dirichlet weight ``mu``), ending at the uniform one over the vocabulary; the end of a
text is an event that takes its share of probability but is not scored.  A text is
scored by models that leave out its own n-grams, so a target text does not know itself.
``lm_score`` is the mean over its words of the target's loss less the background's: the
lower, the more it is like the target.

Texts are written once, in blocks of about ``BLOCK`` bytes, and read from those files by
block; only keys and sides of documents are joined.  A block asks for each of its
distinct 1- to 3-grams once; the requests are dealt into buckets by ranges of their keys,
a bucket sums them up and sends each block its counts back, in the order asked, with
which its texts are scored.  No more than about ``FAN`` askers meet in a bucket: of more
blocks, groups are merged bucket by bucket and ask as one in finer buckets, level by level
(as in a radix sort), and what they are told is handed down to their members.  So a row
holds some thousand n-grams at any size, rows grow with the corpus times the number of
levels (one up to 2 GB, two up to 2 TB), and a word that all texts have costs a bucket a
number an asker.  What is gathered stays partitioned; rows hold packed arrays; only totals
come to the driver.  Keys of n-grams have 16 bits
more than the number of words in the corpus (40 to 60), so one in some 20,000 shares
its key with another at any size.

Defined results: null and empty texts have no words and score 0; with no target text, or
no other, that model is uniform; repeated rows are texts of their own, each knowing its
copies; a column named like an added one is replaced; capitals count as small letters.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill.llm import _store, _text

BITS = 24
BLOCK = 2 << 20
FAN, SPLIT = 1024, 512
_BUCKET_GRAMS = 2_000_000
_TASK_BYTES = 16 << 20
U64 = np.uint64
ADDED = {"n_tokens": "long", "loss_target": "double", "loss_background": "double", "lm_score": "double"}


def blocks(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` less the text, with ``__block``, ``__row`` in it, ``__text`` (lowered) and its words ``__n``."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in (*ADDED, text)}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in _text.slices(batch, "__text"):
                n = np.diff(_text.Words(part.column("__text")).first)
                made = [pa.array(np.full(part.num_rows, block)), pa.array(row + np.arange(part.num_rows), pa.int32()), part.column("__text"), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, "__block", "__row", "__text", "__n"])
                row, held = row + part.num_rows, held + part.column("__text").nbytes
                if held >= BLOCK:
                    block, row, held = block + 1, 0, 0

    schema = StructType(kept)
    for name, kind in (("__block", "long"), ("__row", "integer"), ("__text", "string"), ("__n", "long")):
        schema = schema.add(name, kind)
    lowered = F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    return docs.select(*[F.col(f"`{n}`") for n in names], lowered.alias("__text")).mapInArrow(run, schema)


def gram_keys(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (3, words) of the 1-, 2- and 3-gram that end at each word (texts are led by pads), and the rows' pointers."""
    words = _text.Words(column)
    ids = (words.hashes() >> U64(64 - BITS)) + U64(1)
    place = np.arange(len(ids)) - np.repeat(words.first[:-1], np.diff(words.first))
    keys = np.zeros((3, len(ids)), dtype=np.uint64)
    packed = ids.copy()
    for order in range(3):
        if order:
            earlier = np.concatenate([np.zeros(min(order, len(ids)), np.uint64), ids[:-order]])
            packed = _text.mix(packed) + np.where(place >= order, earlier, U64(0))
        keys[order] = _text.mix(packed * U64(4) + U64(order)) >> U64(64 - bits)
    return keys, words.first


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of each key by its range, so ascending keys are in ascending buckets."""
    return (((keys >> U64(bits - 32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def packed_bits(numbers: np.ndarray) -> bytes:
    """Numbers as bit planes, as many as the largest needs."""
    width = int(numbers.max(initial=0)).bit_length()
    raw = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8]
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].T, axis=1)
    return struct.pack("<IB", len(numbers), width) + planes.tobytes()


def unpacked_bits(raw: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", raw)
    out = np.zeros((n, 8), dtype=np.uint8)
    if n and width:
        planes = np.frombuffer(raw, np.uint8, offset=5).reshape(width, -1)
        own = np.packbits(np.unpackbits(planes, axis=1, count=n).T, axis=1, bitorder="little")
        out[:, : own.shape[1]] = own
    return out.view("<u8").ravel()


def squeezed(counts: np.ndarray) -> bytes:
    """Counts, most of them small, as compressed bit planes."""
    return zstandard.compress(packed_bits(counts), 1)


def unsqueezed(raw: bytes) -> np.ndarray:
    return unpacked_bits(zstandard.decompress(raw))


def own_counts(keys: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """How often the row of each key has it; ``keys`` are numbers under 2 ** 31."""
    pairs = (np.repeat(np.arange(len(pointers) - 1), np.diff(pointers)) << 31) | keys
    _, where, n = np.unique(pairs, return_inverse=True, return_counts=True)
    return n[where].astype(np.float64)


def losses(place: np.ndarray, counts: np.ndarray, pointers: np.ndarray, member: np.ndarray, total: float, texts: float, weight: float, mu: float) -> np.ndarray:
    """Loss of each word under one model.

    ``place`` (3, words) says where each gram's number is in ``counts``; ``member`` tells
    the rows that the model has counted, which are left out of it for their own words.
    """
    n_words = np.diff(pointers)
    inside = np.repeat(member, n_words).astype(np.float64)
    first = np.zeros(place.shape[1], dtype=bool)
    first[pointers[:-1][n_words > 0]] = True
    p = np.full(place.shape[1], 2.0**-BITS)
    above = (total - inside * np.repeat(n_words, n_words)) * weight
    for order in range(3):
        own = (counts[place[order]] - inside * own_counts(place[order], pointers)) * weight
        p = (own + mu * p) / (above + mu)
        if order < 2:
            above = np.concatenate([own[:1] * 0, own[:-1]])
            # a context is counted wherever its last word stands; its own text's counts of it are left out alike
            above = np.where(first, (texts - inside) * weight, above)
    return -np.log(p)


def score(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", mu: float = 4.0, fan: int = FAN, split: int = SPLIT) -> DataFrame:
    """``docs``, less the text, with ``n_tokens``, mean losses and ``lm_score``.

    Texts whose ``key`` is among that of ``targets`` (nulls are not) are the target
    model's, all others the background's.
    """
    spark = docs.sparkSession
    table = _store.written(blocks(docs, text), "lm-texts", compression="zstd", **{"parquet.block.size": BLOCK})
    marks = targets.select(F.col(f"`{key}`").alias("__key"), F.lit(True).alias("target")).where("__key is not null").distinct()
    own = table.select("__block", "__row", "__n", F.col("_metadata.file_path").alias("__file"), F.col(f"`{key}`").alias("__key"))
    sides = own.join(_store.written(marks, "lm-targets").hint("merge"), "__key", "left")  # one plan at every size
    sides = _store.written(sides.select("__block", "__row", "__n", "__file", F.coalesce("target", F.lit(False)).alias("target")), "lm-sides")
    n, has = F.col("__n"), (F.col("__n") > 0).cast("int")
    sums = sides.agg(F.count_if(F.col("__row") == 0).alias("blocks"), *[F.coalesce(F.sum(F.when(side, x)), F.lit(0)).alias(f"{a}{b}") for a, x in (("w", n), ("t", has)) for b, side in ((0, F.col("target")), (1, ~F.col("target")))]).first()
    words_in, texts_in = (sums.w0, sums.w1), (sums.t0, sums.t1)
    least = min(words_in)
    weights = tuple(least / w if least else 1.0 for w in words_in)
    bits = min(60, max(40, sum(words_in).bit_length() + 16))
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least_parts, 3 * sum(words_in) // _BUCKET_GRAMS) if sums.blocks <= fan else split
    parts = max(least_parts, 12 * sum(words_in) // _TASK_BYTES)
    kept = [f for f in table.schema.fields if not f.name.startswith("__")]
    names = [f.name for f in kept]

    def texts_of(paths: list[str], block: int, columns: list[str]) -> pa.Table:
        """The block's rows in order, from the files that hold some."""
        found = []
        for path in paths:
            fs, path = _store.filesystem(path)
            with fs.open_input_file(path) as source:
                file = pq.ParquetFile(source)
                at = file.schema_arrow.names.index("__block")
                spans = [file.metadata.row_group(i).column(at).statistics for i in range(file.num_row_groups)]
                rows = file.read_row_groups([i for i, s in enumerate(spans) if s is None or s.min <= block <= s.max], columns=[*columns, "__block", "__row", "__text"])
            found.append(rows.filter(pc.equal(rows.column("__block"), block)))
        return pa.concat_tables(found).sort_by("__row").combine_chunks()

    def requests(asker: int, own: np.ndarray, counts: list[np.ndarray], buckets: int, once: dict[str, str | bytes]) -> pa.Table:
        """A row for each bucket that ascending keys fall into; ``once`` goes with the first."""
        dealt = bucket_of(own, bits, buckets)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(dealt)) + 1, [len(own)]]).tolist() if len(own) else [0, 0]
        cuts = list(zip(edges[:-1], edges[1:]))
        told = [[packed_bits(np.diff(own[a:b], prepend=own[a : a + 1])) for a, b in cuts], *([squeezed(x[a:b]) for a, b in cuts] for x in counts)]
        heads = [(int(dealt[a]), int(own[a])) if a < b else (0, 0) for a, b in cuts]
        first = [pa.array([once.get(c), *[None] * (len(cuts) - 1)], t) for c, t in (("sides", pa.binary()), ("paths", pa.string()))]
        made = [pa.array(np.full(len(cuts), asker), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*heads)), *first, *(pa.array(x, pa.binary()) for x in told)]
        return pa.Table.from_arrays(made, names=["asker", "bucket", "head", "sides", "paths", "grams", "n_target", "n"])

    def ask(rows: pa.Table) -> pa.Table:
        block, paths = rows.column("__block")[0].as_py(), sorted(rows.column("__file").unique().to_pylist())
        target = rows.sort_by("__row").column("target").to_numpy().astype(bool)
        keys, pointers = gram_keys(texts_of(paths, block, []).column("__text").combine_chunks(), bits)
        own, where, n_all = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
        n_target = np.bincount(where, weights=np.tile(np.repeat(target, np.diff(pointers)), 3), minlength=len(own)).astype(np.uint64)
        once = {"sides": np.packbits(target).tobytes(), "paths": "\n".join(paths)}  # once for each block
        return requests(block, own, [n_target, n_all.astype(np.uint64)], buckets, once)

    def united(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys of all requests, where each request's are among them, the requests' ends)"""
        each = [np.cumsum(unpacked_bits(x), dtype=np.uint64) + U64(h) for x, h in zip(asked.column("grams").to_pylist(), asked.column("head").to_pylist())]
        return *np.unique(np.concatenate(each), return_inverse=True), np.cumsum([len(x) for x in each])[:-1]

    def summed(asked: pa.Table, own: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(where, weights=np.concatenate([unsqueezed(x) for x in asked.column(c).to_pylist()]), minlength=len(own)).astype(np.uint64) for c in ("n_target", "n")]

    def told(asked: pa.Table, sums: list[np.ndarray], where: np.ndarray, stops: np.ndarray) -> pa.Table:
        made = [pa.array([squeezed(x) for x in np.split(total[where], stops)], pa.binary()) for total in sums]
        return pa.Table.from_arrays([*(asked.column(c) for c in ("asker", "bucket", "sides", "paths")), *made], names=["asker", "bucket", "sides", "paths", "n_target", "n"])

    def answer(asked: pa.Table) -> pa.Table:
        own, where, stops = united(asked)
        return told(asked, summed(asked, own, where), where, stops)

    asks = "asker long, bucket long, head long, sides binary, paths string, grams binary, n_target binary, n binary"
    tells = "asker long, bucket long, sides binary, paths string, n_target binary, n binary"

    def answers_to(asked: DataFrame, askers: int, buckets: int) -> DataFrame:
        if askers <= fan:
            return asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(answer, tells)
        groups, finer = math.ceil(askers / fan), buckets * split

        def merge(members: pa.Table) -> pa.Table:
            own, where, _ = united(members)
            asker = members.column("bucket")[0].as_py() * groups + members.column("grp")[0].as_py()
            return requests(asker, own, summed(members, own, where), finer, {})

        def hand_down(members: pa.Table, answers: pa.Table) -> pa.Table:
            own, where, stops = united(members)
            answers = answers.sort_by("bucket")
            sums = [np.concatenate([unsqueezed(x) for x in answers.column(c).to_pylist()]) for c in ("n_target", "n")]
            return told(members, sums, where, stops)

        members = _store.written(asked.withColumn("grp", F.pmod(F.xxhash64("asker"), F.lit(groups))), "lm-asked")
        merged = members.repartition(parts, "bucket", "grp").groupBy("bucket", "grp").applyInArrow(merge, asks)
        found = answers_to(merged, groups, finer).withColumnRenamed("bucket", "finer")
        found = found.select(F.floor(F.col("asker") / groups).alias("bucket"), F.pmod("asker", F.lit(groups)).alias("grp"), F.col("finer").alias("bucket2"), "n_target", "n")
        return members.groupBy("bucket", "grp").cogroup(found.groupBy("bucket", "grp")).applyInArrow(lambda a, b: hand_down(a, b.select(["bucket2", "n_target", "n"]).rename_columns(["bucket", "n_target", "n"])), tells)

    schema = StructType(list(kept))
    for name, kind in ADDED.items():
        schema = schema.add(name, kind)
    arrow = to_arrow_schema(schema)

    def scored(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        whole = texts_of(rows.column("paths").drop_null()[0].as_py().split("\n"), rows.column("asker")[0].as_py(), names)
        target = np.unpackbits(np.frombuffer(rows.column("sides").drop_null()[0].as_py(), np.uint8), count=whole.num_rows).astype(bool)
        keys, pointers = gram_keys(whole.column("__text").combine_chunks(), bits)
        place = np.unique(keys.ravel(), return_inverse=True)[1].reshape(3, -1)
        n_target, n_all = (np.concatenate([unsqueezed(x) for x in rows.column(c).to_pylist()]).astype(np.float64) for c in ("n_target", "n"))
        n, means = np.diff(pointers), []
        for counts, member, words, texts, weight in zip((n_target, n_all - n_target), (target, ~target), words_in, texts_in, weights):
            each = losses(place, counts, pointers, member, words, texts, weight, mu)
            means.append(_text.segment_sums(each, pointers) / np.maximum(n, 1))
        made = [n.astype(np.int64), means[0], means[1], means[0] - means[1]]
        kinds = [arrow.field(x).type for x in names]
        return pa.Table.from_arrays([*(whole.column(x).cast(k, safe=False) for x, k in zip(names, kinds)), *(pa.array(x) for x in made)], schema=arrow)

    asked = sides.repartition(parts, "__block").groupBy("__block").applyInArrow(ask, asks)
    return answers_to(asked, sums.blocks, buckets).repartition(parts, "asker").groupBy("asker").applyInArrow(scored, schema)
