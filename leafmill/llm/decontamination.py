"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of ten consecutive words of a benchmark item (an item of fewer words
is one window) goes into a hash set.  Training texts are scanned window by window
against it; each hit is verified word by word before it counts.  The set is sent in
blocks of at most ``block_windows`` windows and about ``block_bytes`` bytes of words and
item numbers, so a broadcast never outgrows these bounds whatever the benchmark's size; a
batch is scanned against one block after another.  Windows lie end to end in one buffer,
so a worker holds little more than these bytes.

Defined results: null and empty texts have no words and no hits; null item texts
give no window; repeated documents give repeated rows; windows that several items
share count for each of them; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _text

_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32())]))
_BITS = 20


class WindowSet:
    """Windows of items by size: sorted hashes, their words end to end and their items by number, and a bit filter before the search."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]] = {}
        numbers: dict[str, int] = {}
        by_size: dict[int, list[bytes]] = {}
        for key in windows:
            by_size.setdefault(key.count(b" ") + 1, []).append(key)
        for size, keys in sorted(by_size.items()):
            words = _text.Words(pa.array(keys, pa.binary()).view(pa.string()))
            hashes = _text.window_hashes(words.hashes(), size)[words.first[:-1]]
            order = np.argsort(hashes, kind="stable")
            hashes, keys = hashes[order], [keys[i] for i in order.tolist()]
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[hashes >> np.uint64(64 - _BITS)] = True
            ends = np.cumsum([0, *map(len, keys)])
            held = [[numbers.setdefault(item, len(numbers)) for item in windows[key]] for key in keys]
            first = np.cumsum([0, *map(len, held)])
            self.sizes[size] = (seen, hashes, b"".join(keys), ends, np.fromiter((n for own in held for n in own), np.int64, int(first[-1])), first)
        self.items = list(numbers)

    def hits(self, words: _text.Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, size, items) of each verified occurrence in a batch."""
        codes = words.hashes()
        for size, (seen, hashes, held, ends, items, first) in self.sizes.items():
            found = _text.window_hashes(codes, size)
            at = np.flatnonzero(seen[found >> np.uint64(64 - _BITS)])
            at = at[_text.windows_of(words.first, len(codes), size)[at]]
            slot = np.searchsorted(hashes, found[at])
            good = slot < len(hashes)
            at, slot = at[good], slot[good]
            good = hashes[slot] == found[at]
            for i, s in zip(at[good].tolist(), slot[good].tolist()):
                own = b" ".join([words.word(i + k) for k in range(size)])
                while s < len(hashes) and hashes[s] == found[i]:
                    if held[ends[s] : ends[s + 1]] == own:
                        yield i, size, [self.items[n] for n in items[first[s] : first[s + 1]].tolist()]
                    s += 1


def item_windows(rows: Iterator[tuple[str, str | None]], size: int) -> Iterator[tuple[bytes, str]]:
    """(words of a window with a space between two, item)."""
    for item, text in rows:
        words = _text.Words(pa.array([text], pa.string()))
        own = [words.word(i) for i in range(len(words.starts))]
        for i in range(max(1, len(own) - size + 1) if own else 0):
            yield b" ".join(own[i : i + size]), item


def _blocks(items: DataFrame, item_id: str, item_text: str, size: int, block_windows: int, block_bytes: int) -> Iterator[WindowSet]:
    windows: dict[bytes, list[str]] = {}
    held = 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).toLocalIterator()
    for key, item in item_windows(((r.i, r.t) for r in rows), size):
        if key not in windows:
            windows[key] = []
            held += len(key)
        if windows[key][-1:] != [item]:  # an item's windows come together
            windows[key].append(item)
            held += 8
        if len(windows) >= block_windows or held >= block_bytes:
            yield WindowSet(windows)
            windows, held = {}, 0
    if windows:
        yield WindowSet(windows)


def _scan(column: pa.Array, blocks: list) -> tuple[pa.Array, pa.Array, pa.Array]:
    words = _text.Words(column)
    rows = len(column)
    edge = np.zeros(len(words.starts) + 1, dtype=np.int32)
    items: list[set[str]] = [set() for _ in range(rows)]
    for block in blocks:
        for i, size, held in block.value.hits(words):
            edge[i] += 1
            edge[i + size] -= 1
            items[int(np.searchsorted(words.first, i, side="right")) - 1].update(held)
        if len(blocks) > 1:
            del block._value  # one block in memory at a time; the next look loads it again
    hit = np.cumsum(edge)[:-1] > 0
    spans: list[list[dict]] = [[] for _ in range(rows)]
    if hit.any():
        turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            while a < b:  # a run of hit words may go on into the next row
                d = int(np.searchsorted(words.first, a, side="right")) - 1
                stop, base, byte = min(b, int(words.first[d + 1])), int(words.first[d]), int(words.offsets[d])
                spans[d].append({"first": a - base, "stop": stop - base, "start_byte": int(words.starts[a]) - byte, "end_byte": int(words.ends[stop - 1]) - byte})
                a = stop
    return pa.array(np.diff(words.first), pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_windows: int = 500_000, block_bytes: int = 64 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with ``n_words``, hit ``spans`` (in words and bytes) and ``items`` found."""
    spark = docs.sparkSession
    scanned = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(items, item_id, item_text, size, block_windows, block_bytes)]
    part_bytes = (1 if len(blocks) < 2 else 16) << 20

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "__text", part_bytes):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *_scan(part.column("__text"), blocks)], names=[*keep, "n_words", "spans", "items"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema if f.name != "__text")
    return scanned.mapInArrow(scan, f"{kinds}, n_words bigint, spans array<struct<first:int,stop:int,start_byte:int,end_byte:int>>, items array<string>")


def n_hit(spans: str = "spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda a, x: a + (x["stop"] - x["first"]))


def _reported(docs: DataFrame, items: DataFrame, text: str, options: dict) -> tuple[DataFrame, list[str], str]:
    """The report on all columns under plain names, which cannot clash with its own; those names, and the text's."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    own = plain[docs.columns.index(text)]
    return find_contamination(docs.toDF(*plain), items, text=own, keep=tuple(plain), **options), plain, own


def remove_documents(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    found, plain, _ = _reported(docs, items, text, options)
    return found.where(F.size("items") == 0).select(*plain).toDF(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with the hit spans cut out of their texts."""
    found, plain, own = _reported(docs, items, text, options)
    raw = F.col(own).cast("binary")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.unhex(F.lit("")).alias("out")),
        lambda a, x: F.struct(x["end_byte"].alias("at"), F.concat(a["out"], F.substring(raw, a["at"] + 1, x["start_byte"] - a["at"])).alias("out")),
        lambda a: F.concat(a["out"], F.substring(raw, a["at"] + 1, F.octet_length(raw) - a["at"])).cast("string"),
    )
    return found.withColumn(own, F.when(F.size("spans") > 0, cut).otherwise(F.col(own))).select(*plain).toDF(*docs.columns)
