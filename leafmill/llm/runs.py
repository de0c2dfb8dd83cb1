"""Periodic runs of words, found by naming windows of power-of-two lengths.

Words are the stretches without ASCII white space.  Level k names every window of 2^k
words of a text by the pair of names of its halves (Karp, Miller and Rosenberg), so two
windows have one name exactly where their words are equal.  A window that stands but
once in its text needs no name, nor does any window that holds it, so prose drops out
after a few levels.  The longest common extension of two places is read off the levels
from the longest windows down.

A run of period p and at least max(24, 3 p) words covers a place i of a grid of step p
(of step 8 for p < 8) whose next p (8) words recur p words on: two look-ups of names for
each place of the grid, n log n in all.  Each chain of such places is extended both ways.

Defined results: null and empty texts have no words and no runs; the longest texts are
worked on whole, alone in their slice; equal texts have equal runs; a stretch that has
several periods is a run of the smallest one alone; repeated rows are rows of their own,
an empty table gives an empty one, and an added column replaces one of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _text

LEAST_WORDS, LEAST_POWERS = 24, 3
_SMALL, _SMALL_LEVEL = 8, 3  # periods under 8 share a grid of step 8
_GRID_PIECE = 1 << 20
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Words:
    """The words of a batch end to end: ``packed`` bytes, ``lengths``, and ``first[d]:first[d + 1]`` those of row d."""

    def __init__(self, column: pa.Array):
        data, offsets = _text.utf8(column)
        inside = ~_IS_SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        opens[edges] = inside[edges]
        starts = np.flatnonzero(opens)
        self.first = np.searchsorted(starts, offsets)
        self.packed = data[inside]
        at = np.concatenate([np.cumsum(inside)[starts] - 1, [len(self.packed)]]) if len(starts) else np.zeros(1, np.int64)
        self.lengths = np.diff(at)
        own = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(self.packed)])
        self.codes = own.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each row's kept words with one space between two."""
        lengths = self.lengths[keep]
        ends = np.cumsum(lengths + 1)
        buffer = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
        is_word = np.ones(len(buffer), dtype=bool)
        is_word[ends - 1] = False
        buffer[is_word] = self.packed[np.repeat(keep, self.lengths)]
        counts = np.concatenate([[0], np.cumsum(keep)])[self.first]
        stops = np.concatenate([[0], ends])[counts]
        last = stops[1:][np.diff(counts) > 0] - 1  # no space after a row's last word
        buffer = np.delete(buffer, last)
        offsets = stops - np.concatenate([[0], np.cumsum(np.diff(counts) > 0)])
        return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)]).cast(pa.string())


def _named(keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal keys; -1 for those that stand alone."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])
    name = np.empty(len(keys), dtype=np.int32)
    name[order] = np.where(new[:-1] & new[1:], -1, np.cumsum(new[:-1]))
    return name


class Names:
    """``levels[k][i]`` names the 2^k words from i on; -1 where they stand once in their row or pass its end."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        n = len(codes)
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        stop = first[1:][self.row]
        self.levels = [np.append(_named(self.row * (codes.max(initial=0) + 1) + codes), np.int32(-1))]
        at, width = np.flatnonzero(self.levels[0] >= 0), 1
        while True:
            lower = self.levels[-1]
            at = at[at + 2 * width <= stop[at]]
            at = at[lower[at + width] >= 0]
            if not len(at):
                return
            found = _named(lower[at].astype(np.int64) * (n + 1) + lower[at + width])
            at, found = at[found >= 0], found[found >= 0]
            if not len(at):
                return
            level = np.full(n + 1, -1, dtype=np.int32)
            level[at] = found
            self.levels.append(level)
            width *= 2

    def same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        names = self.levels[level]
        found = names[i]
        return (found >= 0) & (found == names[j])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for i < j of one row."""
        got = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.levels))):
            got += self.same(level, i + got, j + got).astype(np.int64) << level
        return got

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        got = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.levels))):
            a = i - got - (1 << level)
            good = np.flatnonzero(a >= 0)
            got[good] += self.same(level, a[good], (j - got - (1 << level))[good]).astype(np.int64) << level
        return got


def _grid(names: Names, first: np.ndarray, level: int):
    """(places, periods, step, chain breaks) of the grids of the periods from 2^level on, piece by piece."""
    rows = np.unique(names.row[np.flatnonzero(names.levels[level] >= 0)])
    size = np.diff(first)[rows]
    least = 1 << level
    jobs = [(least, 2 * least, None)]
    if level == _SMALL_LEVEL:
        jobs.append((1, _SMALL, _SMALL))
    for low, high, fixed in jobs:
        # the periods of each row, and the number of places of each period's grid
        count = np.maximum(np.minimum(high - 1, size // LEAST_POWERS) - low + 1, 0)
        row, n = np.repeat(rows, count), np.repeat(size, count)
        period = low + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        step = period if fixed is None else np.full(len(row), fixed)
        places = np.maximum((n - period - step) // step + 1, 0)
        piece = (np.cumsum(places) - places) // _GRID_PIECE
        for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(piece)]]))):
            own = places[a:b]
            begins = np.cumsum(own) - own
            m = np.arange(int(own.sum())) - np.repeat(begins, own)
            wide = np.repeat(step[a:b], own)
            yield np.repeat(first[row[a:b]], own) + m * wide, np.repeat(period[a:b], own), wide, m == 0


def find(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, stop, period) of all runs of a batch, by first word, then period."""
    names = Names(words.codes, words.first)
    found = []
    for level in range(_SMALL_LEVEL, len(names.levels)):
        for place, period, step, fresh in _grid(names, words.first, level):
            at = np.flatnonzero(names.same(level, place, place + period))  # the block's first 2^level words, then its last
            tail = place[at] + step[at] - (1 << level)
            at = at[names.same(level, tail, tail + period[at])]
            hit = np.zeros(len(place) + 1, dtype=bool)
            hit[at] = True
            at = at[fresh[at] | ~hit[at - 1]]  # a place whose forerunner is a hit too lies in the same run
            i, p = place[at], period[at]
            start, stop = i - names.back(i, i + p), i + p + names.ahead(i, i + p)
            good = stop - start >= np.maximum(LEAST_WORDS, LEAST_POWERS * p)
            found.append((start[good], stop[good], p[good]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, stop, period = map(np.concatenate, zip(*found))
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])  # multiples of the smallest period go
    start, stop, period = start[first], stop[first], period[first]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _made(column: pa.Array) -> list[pa.Array]:
    words = Words(column)
    start, stop, period = find(words)
    change = np.zeros(len(words.codes) + 1, dtype=np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    row = np.searchsorted(words.first, start, side="right") - 1
    fields = [pa.array(x, pa.int64()) for x in (start - words.first[row], stop - start, period)]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.first), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [lists, words.joined(np.cumsum(change)[:-1] == 0)]


def with_runs(docs: DataFrame, *, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the ``runs`` of each text (in words, by start, then period) and the text without the words a run repeats.

    A word goes if a run holds it after that run's first period; those that stay are
    joined by one space.
    """
    return _text.appended(docs, _made, {runs: RUNS, collapsed: "string"}, text)


def strongest(runs: Column) -> Column:
    """The run of the greatest length in periods; of equal ones the first, then that of the smallest period; null if there is none."""
    none = F.element_at(runs, F.lit(1))
    # lengths in periods are compared as products of whole numbers; runs come by start, then period
    return F.when(F.size(runs) > 0, F.aggregate(runs, none, lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)))


def collapse(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with each text that has runs replaced by its collapsed form; other texts stay as they are."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    own = plain[docs.columns.index(text)]
    made = with_runs(docs.toDF(*plain), text=own)
    return made.withColumn(own, F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(own))).select(*plain).toDF(*docs.columns)
