"""Document fingerprints by content-defined chunking.

A gear hash (shift and add over the last ``WINDOW`` bytes) marks chunk ends under two
masks: a strict one before the wanted size, a loose one after it, which keeps chunk
sizes close to it.  Ends depend on nearby bytes alone, so an insertion moves no
boundary but those around it.  A text's fingerprint is its set of chunk digests, each
weighted by the chunk's length; containment of one in another is the share of the
first's weight that the second also holds.

Defined results: null and empty texts have an empty fingerprint; two empty ones
contain each other (1.0), and an empty one is not contained in any other (0.0); equal
texts have equal fingerprints, whatever stands around them.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm import _order, _text

WINDOW, SMALLEST, WANTED, LARGEST = 16, 16, 48, 192
_STRICT, _LOOSE = np.uint32(0x3F << 10), np.uint32(0x0F << 12)
_GEAR = np.random.default_rng(48).integers(0, 1 << 16, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """16-bit gear hash of the last WINDOW bytes at each position, by doubling."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h & np.uint32(0xFFFF)


def chunk_ends(strict: list[int], loose: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of one text, from its candidate ends."""
    ends = []
    while stop - start > SMALLEST:
        middle, last = min(start + WANTED, stop), min(start + LARGEST, stop)
        i = bisect_left(strict, start + SMALLEST)
        if i < len(strict) and strict[i] < middle:
            start = strict[i]
        else:
            i = bisect_left(loose, middle)
            start = loose[i] if i < len(loose) and loose[i] < last else last
        ends.append(start)
    if start < stop:
        ends.append(stop)
    return ends


def fingerprints(texts: list[bytes]) -> list[frozenset[int]]:
    """Sets of ``digest << 8 | length`` of the chunks of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h = gear(data) if len(data) else np.zeros(0, np.uint32)
    strict, loose = (np.flatnonzero((h & mask) == 0) + 1 for mask in (_STRICT, _LOOSE))
    ends: list[int] = []
    counts = []
    s_at, l_at = np.searchsorted(strict, offsets), np.searchsorted(loose, offsets)
    strict_list, loose_list = strict.tolist(), loose.tolist()
    for i in range(len(texts)):
        own = chunk_ends(strict_list[s_at[i] : s_at[i + 1]], loose_list[l_at[i] : l_at[i + 1]], int(offsets[i]), int(offsets[i + 1]))
        ends += own
        counts.append(len(own))
    stops = np.array(ends, dtype=np.int64)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    codes = _text.span_hashes(_text.BYTE_CODES[data], starts, stops)
    entries = (((codes >> np.uint64(24)) << np.uint64(8)) | (stops - starts).astype(np.uint64)).tolist()
    at = np.concatenate([[0], np.cumsum(counts)]).astype(int).tolist()
    return [frozenset(entries[a:b]) for a, b in zip(at[:-1], at[1:])]


def as_text(chunks: frozenset[int]) -> str:
    """Six bytes a chunk (40 bits of digest, the length), ascending, in base64."""
    return base64.b64encode(b"".join(x.to_bytes(6, "big") for x in sorted(chunks))).decode()


def from_text(text: str) -> frozenset[int]:
    raw = base64.b64decode(text)
    return frozenset(int.from_bytes(raw[i : i + 6], "big") for i in range(0, len(raw), 6))


def containment(a: frozenset[int], b: frozenset[int]) -> float:
    """Share of the length of ``a``'s chunks that ``b`` holds too."""
    if not a:
        return float(not b)
    return sum(x & 0xFF for x in a & b) / sum(x & 0xFF for x in a)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprint(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text."""
    made = lambda texts: [pa.array([as_text(x) for x in fingerprints([(t or "").encode() for t in texts.to_pylist()])], pa.string())]
    return _text.appended(docs, made, {name: "string"}, text)


def compare_with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint and text against an edited one and against the next document by key."""
    ordered, _ = _order.in_order(docs, key, text, neighbours=True)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(keys: list, texts: list[str], after: str) -> pa.RecordBatch:
        following = [*texts[1:], after]
        changed = [edited(a, b).encode() for a, b in zip(texts, following)]
        prints = fingerprints([t.encode() for t in [*texts, after]])
        edits = fingerprints(changed)
        cols = [
            keys,
            [len(t) for t in texts],
            [hashlib.sha256(c).hexdigest() for c in changed],
            [as_text(p) for p in prints[:-1]],
            [as_text(p) for p in edits],
            [containment(a, b) for a, b in zip(prints, edits)],
            [containment(a, b) for a, b in zip(prints, prints[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size, after = [], [], 0, None
        for batch in batches:
            for own, one_key, one in zip(*(batch.column(c).to_pylist() for c in ("own", "key", "text"))):
                if not own:
                    after = one if after is None else after
                    continue
                if size >= 1 << 20:
                    yield compared(keys, texts, one)
                    keys, texts, size = [], [], 0
                keys.append(one_key)
                texts.append(one)
                size += len(one)
        if keys:
            yield compared(keys, texts, texts[0] if after is None else after)

    return ordered.mapInArrow(run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
