"""Vectorised text primitives over Arrow string columns.

A batch of texts is one UTF-8 byte array plus document offsets, so words, word
windows and character n-grams come from a few numpy passes and no Python string
is made per document.  Words are the maximal runs of ASCII digits, ASCII letters
(A-Z lowered) and bytes from 0x80 up, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after lowering A-Z.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
SLICE_BYTES = 1 << 19
_KEPT_POWERS = SLICE_BYTES + 64
_powers: dict[int, np.ndarray] = {}


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``max_bytes`` of ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def appended(docs: DataFrame, made: Callable[[pa.Array], list[pa.Array]], added: dict[str, str], text: str) -> DataFrame:
    """``docs`` with columns made from its texts; a column of the same name (whatever its case) is replaced."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]
    names = [f.name for f in kept]
    shared = any(f.name == text and f.dataType == StringType() for f in kept)  # then the text travels once
    own = text if shared else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, own):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made(part.column(own))], names=[*names, *added])

    schema = StructType([*kept, *StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in added.items())).fields])
    columns = [F.col(f"`{n}`") for n in names]
    if not shared:
        columns.append(F.col(f"`{text}`").cast("string").alias("__text"))
    return docs.select(*columns).mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _powers_of(base: int, n: int) -> np.ndarray:
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        made = np.full(max(n, _KEPT_POWERS), base, dtype=np.uint64)
        made[0] = 1
        kept = np.multiply.accumulate(made)
        if n <= _KEPT_POWERS:
            _powers[base] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all of its input."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a code array, wherever they stand in it."""
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _powers_of(_BASE, len(codes)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers_of(_BASE_INVERSE, len(codes) + 1)[starts])


class Words:
    """The words of a batch: ``starts``/``ends`` in ``lowered``, ``first[d]:first[d + 1]`` those of row d."""

    def __init__(self, column: pa.Array):
        data, self.offsets = utf8(column)
        self.lowered = LOWER[data]
        inside = IS_WORD[self.lowered]
        n = len(inside)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(BYTE_CODES[self.lowered], self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.lowered[self.starts[i] : self.ends[i]].tobytes()


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (those past the end are cut off)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(size):
        total += hashes[k : k + n] * U64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total)


def windows_of(first: np.ndarray, n_hashes: int, size: int) -> np.ndarray:
    """Mask over window starts: True where the window stays inside its row."""
    n = n_hashes - size + 1
    good = np.ones(max(n, 0), dtype=bool)
    for k in range(1, size):
        at = first[1:] - k
        at = at[(at >= 0) & (at < n)]
        good[at] = False
    return good


def segment_sums(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Sums of ``values[pointers[i]:pointers[i + 1]]`` along axis 0; empty segments are 0."""
    out = np.zeros((len(pointers) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(pointers[1:] > pointers[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: pointers[-1]], pointers[:-1][full], axis=0)
    return out


def rolling_grams(lowered: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, 32-bit hashes of the ``size`` bytes from each position on), sizes ascending; rows are not looked at."""
    yield from rolling_codes((BYTE_CODES >> U64(32)).astype(np.uint32)[lowered], sizes)


def rolling_codes(codes: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """As ``rolling_grams``, of any symbols given as 32-bit codes."""
    total = np.zeros(len(codes), dtype=np.uint32)
    for size in range(1, min(max(sizes), len(codes)) + 1):
        total = total[: len(codes) - size + 1] * np.uint32(0x01000193) + codes[size - 1 :]
        if size in sizes:
            h = (total ^ (total >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield size, h ^ (h >> np.uint32(13))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of the characters of UTF-8 texts (a code point each), and the rows' offsets in them."""
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(lead)
    width = np.diff(np.append(starts, len(data)))
    whole = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(width > k)
        whole[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    codes = (whole ^ (whole >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    codes = (codes ^ (codes >> np.uint32(12))) * np.uint32(0x297A2D39)
    return codes ^ (codes >> np.uint32(15)), np.concatenate([[0], np.cumsum(lead)])[offsets]


def row_grams(codes: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the grams inside rows, pointers of the rows in them) for each size that occurs."""
    for size, hashes in rolling_codes(codes, sizes):
        lengths = np.maximum(np.diff(offsets) - (size - 1), 0)
        yield hashes[windows_of(offsets, len(codes), size)], np.concatenate([[0], np.cumsum(lengths)])


def summed_vectors(rows, width: int):
    """Add up rows ``(name, slice, counts)`` of int64 vectors by name and slice; each sum has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = sums.setdefault((name, part), np.zeros(width, dtype=np.int64))
                own += np.frombuffer(counts.as_buffer(), "<i8")
        if sums:
            yield vector_rows([(*k, v) for k, v in sums.items()])

    return rows.repartition("name", "slice").mapInArrow(add, VECTOR_ROWS)


VECTOR_ROWS = "name string, slice int, counts binary"


def vector_rows(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].astype("<i8").tobytes() for r in rows], pa.binary())],
        names=["name", "slice", "counts"],
    )
