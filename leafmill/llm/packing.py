"""Packing: documents' token ids into sequences of a fixed window, by best-fit decreasing.

Each task packs the documents it reads, in blocks of at most ``block_tokens`` tokens,
so nothing is shuffled and memory does not depend on the input.  A document (its ids
and an end id) longer than the window is first cut into full windows.  The rest goes,
longest first, to the tightest open window with room, which a segment tree indexed by
remaining capacity finds in a few steps; where none has room, a window opens.  Windows
left emptier than ``max_waste`` of the window are joined end to end and cut anew, so
even equal lengths that do not pair up (a third of all rows may be copies) leave
little padding.  A sequence whose length is a power of two needs no padding.

Defined results: null and empty texts are the end id alone; repeated rows are packed
each; no rows give no pieces.  Sequence ids are unique over tasks and stable as long
as the input's splits are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from leafmill.llm import _text
from leafmill.llm.tokens import Encoder


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of their counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.held: dict[int, list[int]] = {}

    def _count(self, room: int, change: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += change
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.held.setdefault(room, []).append(sequence)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest window with at least ``need`` room."""
        i = need + self.leaves
        if not self.counts[i]:
            while i > 1 and (i & 1 or not self.counts[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.counts[2 * i])
        room = i - self.leaves
        self._count(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Sequences as lists of item numbers; every length is below the window."""
    windows, sequences = OpenWindows(window), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = windows.take(lengths[item])
        if found is None:
            found = (window, len(sequences))
            sequences.append([])
        room, sequence = found
        sequences[sequence].append(item)
        if room > lengths[item]:
            windows.put(room - lengths[item], sequence)
    return sequences


def plan(sizes: list[int], window: int, max_waste: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that cover documents of these sizes."""
    sequences = [[(d, at, window)] for d, n in enumerate(sizes) for at in range(0, n - n % window, window)]
    rests = [(d, n - n % window, n % window) for d, n in enumerate(sizes) if n % window]
    loose: list[tuple[int, int, int]] = []
    for items in best_fit_decreasing([r[2] for r in rests], window):
        held = [rests[i] for i in items]
        filled = sum(r[2] for r in held)
        if window - filled <= max_waste * window or not filled & (filled - 1):
            sequences.append(held)
        else:
            loose += held
    own: list[tuple[int, int, int]] = []
    room = window
    for d, at, n in loose:
        while n:
            cut = min(n, room)
            own.append((d, at, cut))
            at, n, room = at + cut, n - cut, room - cut
            if not room:
                sequences.append(own)
                own, room = [], window
    return [*sequences, own] if own else sequences


def pack(docs: DataFrame, *, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, window: int = 2048, max_waste: float = 0.01, block_tokens: int = 1 << 23) -> DataFrame:
    """Pieces: key, ``start`` and ``length`` in the document, ``ids`` (little-endian uint32), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence and its ``padded_length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        task, made = TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        docs_ids: list[np.ndarray] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            names = pa.concat_arrays(keys)
            rows: list[tuple] = []
            size = 0
            for sequence in plan([len(x) for x in docs_ids], window, max_waste):
                filled = sum(n for _, _, n in sequence)
                padded = filled if not filled & (filled - 1) else window
                offset = 0
                for d, start, n in sequence:
                    rows.append((d, start, n, len(docs_ids[d]), (task << 36) + made, offset, padded))
                    offset += n
                size += offset
                made += 1
                if size >= 1 << 20:
                    yield batch_of(names, rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(names, rows)
            keys.clear()
            docs_ids.clear()
            held = 0

        def batch_of(names: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            d, start, n, whole, sequence, offset, padded = zip(*rows)
            ids = [docs_ids[i][a : a + k].tobytes() for i, a, k in zip(d, start, n)]
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(d, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(whole, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(padded, pa.int64())],
                names=schema.names,
            )

        for batch in batches:
            for part in _text.slices(batch, "text"):
                row = 0
                for ids, pointers in encoder.encode(part.column("text")):
                    ids = np.insert(ids, pointers[1:], end_id).astype("<u4")
                    pointers = pointers + np.arange(len(pointers))
                    docs_ids += [ids[a:b] for a, b in zip(pointers[:-1].tolist(), pointers[1:].tolist())]
                    keys.append(part.column("key").slice(row, len(pointers) - 1))
                    row += len(pointers) - 1
                    held += len(ids)
                if held >= block_tokens:
                    yield from packed()
        if keys:
            yield from packed()

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([StructField(key, rows.schema["key"].dataType)])
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("padded_length", "long")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
