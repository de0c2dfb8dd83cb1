"""Rows in the order of an integer key, in parts of about equal row counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES, UNKNOWN = 8 << 20, 1 << 60


def in_order(docs: DataFrame, key: str, text: str, *, neighbours: bool = False, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """``(part, own, key, text)`` sorted by (key, text) inside each part, parts ascending by key; and their number.

    Null keys come first.  At most 100,000 parts are made, so that their bounds stay small;
    larger tables have larger parts, which their readers take as a stream.  With ``neighbours``, each part that has rows also ends with
    a copy (``own`` false) of the first row of the next one, the last part with that of
    the first.  Only part bounds and first keys, as many as there are parts, come to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:  # not a table's: Spark takes the greatest number for plans it knows nothing of
        size = rows.select(F.sum(F.octet_length("text") + 8).alias("size")).first().size or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_bytes)), 100_000)
    shares = [i / parts for i in range(1, parts)]
    found = rows.select(F.percentile_approx("key", F.array(*map(F.lit, shares)), F.lit(20 * parts)).alias("b")).first().b if shares else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    def part_of(keys: pa.Array) -> np.ndarray:
        return np.where(np.asarray(pc.is_null(keys)), 0, np.searchsorted(bounds, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), side="right"))

    # For each part, the one before it that has rows (-1: none), and its first key.
    before = np.full(len(bounds) + 1, -1, dtype=np.int32)
    first_key, first_null = np.zeros(len(before), dtype=np.int64), np.zeros(len(before), dtype=bool)
    if neighbours:

        def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[int, int] = {}
            for batch in batches:
                keys = batch.column(0)
                part = part_of(keys)
                values = np.where(np.asarray(pc.is_null(keys)), np.iinfo(np.int64).min, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False))
                order = np.lexsort((values, part))
                head = np.flatnonzero(np.diff(part[order], prepend=-1))
                for i in order[head].tolist():
                    least[int(part[i])] = min(least.get(int(part[i]), np.iinfo(np.int64).max), int(values[i]))
            yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.int32()), pa.array(least.values(), pa.int64())], names=["part", "first"])

        heads = {r.part: r.first_key for r in rows.select("key").mapInArrow(firsts, "part int, first bigint").groupBy("part").agg(F.min("first").alias("first_key")).collect()}
        used = np.array(sorted(heads), dtype=np.int64)
        before[used] = np.roll(used, 1)
        first_key[used] = [heads[p] for p in used.tolist()]
        first_null = first_key == np.iinfo(np.int64).min

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            part = part_of(keys)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.ones(len(part), dtype=bool)), keys, batch.column(1)], names=["part", "own", "key", "text"])
            null = np.asarray(pc.is_null(keys))
            values = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
            at = before[part]
            copies = np.flatnonzero((at >= 0) & (null == first_null[part]) & (null | (values == first_key[part])))
            if len(copies):
                take = pa.array(copies)
                yield pa.RecordBatch.from_arrays([pa.array(at[copies], pa.int32()), pa.array(np.zeros(len(copies), dtype=bool)), keys.take(take), batch.column(1).take(take)], names=["part", "own", "key", "text"])

    routed = rows.mapInArrow(route, "part int, own boolean, key bigint, text string")
    n = len(bounds) + 1
    return routed.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("own").desc(), F.col("key").asc_nulls_first(), "text"), n
