"""Toxicity: a counterfactually regularised linear classifier.

Features are the presence of hashed words, of character n-grams (4 to 6 bytes) inside
words and of those that begin a word.
Training takes at most ``max_rows`` labelled rows per class (those with the smallest
key hashes; the class weights restore the labels' proportions).  It counts in how many texts of either class each feature
occurs, keeps the ``n_features`` with the strongest association, and fits logistic
regression under an L2 penalty and a counterfactual one: each labelled sentence that
holds an identity term, and each neutral mention of ``TEMPLATES``, is also seen with the
term swapped for every other of its group, and ``swap_weight`` times the mean squared
change of the logit is added to the loss.  So group names as such cannot move a score,
which keeps neutral mentions from being flagged; the templates make that hold for terms
that no labelled text has, whose letters may be those of other words.

Defined results: null and empty texts get the score of no features; unlabelled rows
and rows whose label is null teach nothing; with one class or no labels at all every
score is the smoothed share of that label.  The model has a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _text

#: Identity terms that may stand for one another, by group.
IDENTITY_GROUPS = (
    ("women", "men", "transgender people", "nonbinary people"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("ausländer", "inländer"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
#: Neutral mentions of a group, seen with every term that fits.
TEMPLATES = ("{} are our neighbours.", "My friends are {}.", "The new colleague is {}.", "We talked about {} history in school.")
SIZES = (4, 5, 6)
_SLICES = 32


@dataclass
class Model:
    bits: int
    column: np.ndarray = field(repr=False)  # bucket -> feature or -1
    weights: np.ndarray = field(repr=False)
    bias: float = 0.0

    def tells(self) -> bool:
        """Has it learned from labels of both kinds?"""
        return bool((self.column >= 0).any())

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, features = features_of(column, self.column, self.bits)
        logit = self.bias + np.bincount(rows, weights=self.weights[features], minlength=len(column))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


def _buckets(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start position, bucket) of the grams inside words, of those that begin a word, and of whole words."""
    words = _text.Words(column)
    inside = _text.IS_WORD[words.lowered]
    begins = np.zeros(len(inside), dtype=bool)
    begins[words.starts] = True
    run = inside.copy()
    for size, codes in _text.rolling_grams(words.lowered, tuple(range(1, max(SIZES) + 1))):
        run = run[: len(codes)] & inside[size - 1 :]
        if size in SIZES:
            at = np.flatnonzero(run & _text.windows_of(words.offsets, len(inside), size))
            yield at, codes[at] >> np.uint32(32 - bits)
            at = at[begins[at]]
            yield at, (codes[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    yield words.starts, (words.hashes() >> np.uint64(64 - bits)).astype(np.uint32)


def presence(column: pa.Array, bits: int) -> np.ndarray:
    """Sorted distinct ``row << 32 | bucket`` of a batch."""
    _, offsets = _text.utf8(column)
    parts = [np.zeros(0, np.int64)]
    for at, buckets in _buckets(column, bits):
        rows = np.searchsorted(offsets, at, side="right") - 1
        parts.append((rows << 32) | buckets.astype(np.int64))
    return np.unique(np.concatenate(parts))


def features_of(column: pa.Array, kept: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a batch, of kept features only."""
    _, offsets = _text.utf8(column)
    parts = [np.zeros(0, np.int64)]
    for at, buckets in _buckets(column, bits):
        feature = kept[buckets]
        good = feature >= 0
        parts.append(((np.searchsorted(offsets, at[good], side="right") - 1) << 32) | feature[good])
    pairs = np.unique(np.concatenate(parts))
    return pairs >> 32, pairs & 0xFFFFFFFF


def swapped_sentences(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> Iterator[tuple[str, str]]:
    """(sentence, sentence with its identity terms swapped) for every other term of a group."""
    others = {term: group for group in groups for term in group}
    pattern = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, others), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        for group in dict.fromkeys(others[m.group(0).lower()] for m in pattern.finditer(sentence)):
            for turn in range(1, len(group)):
                yield sentence, pattern.sub(lambda m: group[(group.index(m[0].lower()) + turn) % len(group)] if m[0].lower() in group else m[0], sentence)


def neutral_pairs(groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[tuple[str, str]]:
    """The templates with each term, paired with those of every other term of its group."""
    return [(t.format(a), t.format(b)) for t in TEMPLATES for group in groups for a in group for b in group if a < b]


def _changes(pairs: list[tuple[str, str]], kept: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """``(-1, features of the first text alone, of the second alone)`` of each pair."""
    owner, feature = features_of(pa.array([x for p in pairs for x in p], pa.string()), kept, bits)
    split = np.split(feature, np.searchsorted(owner, np.arange(1, 2 * len(pairs))))
    return [(-1, np.setdiff1d(a, b).astype("<i4").tobytes(), np.setdiff1d(b, a).astype("<i4").tobytes()) for a, b in zip(split[::2], split[1::2])]


def _document_counts(labelled: DataFrame, bits: int) -> np.ndarray:
    """Texts with each bucket, by class: a (2, 2 ** bits) matrix."""
    width = (1 << bits) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                label = np.array(part.column("label").to_pylist())
                pairs = presence(part.column("text"), bits)
                for k in (0, 1):
                    own[k] += np.bincount(pairs[label[pairs >> 32] == k] & 0xFFFFFFFF, minlength=1 << bits)
        if own.any():
            yield _text.vector_rows([(str(k), i, own[k, i * width : (i + 1) * width]) for k in (0, 1) for i in range(_SLICES)])

    out = np.zeros((2, 1 << bits), dtype=np.int64)
    for row in _text.summed_vectors(labelled.mapInArrow(count, _text.VECTOR_ROWS), width).toLocalIterator():
        out[int(row.name), row.slice * width : (row.slice + 1) * width] = np.frombuffer(bytes(row.counts), "<i8")
    return out


def _select(counts: np.ndarray, n: np.ndarray, n_features: int, bits: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        odds = np.log((counts + 0.5) / (n[:, None] - counts + 0.5))
        spread = np.sqrt((1 / (counts + 0.5)).sum(axis=0))
    strength = np.abs(odds[1] - odds[0]) / spread
    strength[counts.sum(axis=0) < 3] = 0
    best = np.sort(np.argsort(-strength, kind="stable")[:n_features])
    kept = np.full(1 << bits, -1, dtype=np.int64)
    best = best[strength[best] > 0]
    kept[best] = np.arange(len(best))
    return kept


def minimise(loss, w: np.ndarray, steps: int = 200, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving; ``loss`` gives the value and the gradient."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, held = slope.copy(), []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            held.append(a)
            way -= a * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(held)):
            way += s * (a - y @ way / (s @ y))
        step, gain = 1.0, slope @ way
        while step > 1e-10:
            new_value, new_slope = loss(w - step * way)
            if new_value <= value - 1e-4 * step * gain:
                break
            step /= 2
        else:
            break
        s, y = -step * way, new_slope - slope
        w, slope = w + s, new_slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        if value - new_value < 1e-9 * max(1.0, abs(value)):
            break
        value = new_value
    return w


def fit(sizes: np.ndarray, features: np.ndarray, labels: np.ndarray, weights: np.ndarray, change_sizes: np.ndarray, change_feature: np.ndarray, change_sign: np.ndarray, n_features: int, l2: float, swap_weight: float) -> tuple[np.ndarray, float]:
    """Weights and bias; the ``change`` arrays hold features and +1/-1 of each swapped sentence against its own."""
    ends, change_ends = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (sizes, change_sizes))
    changes = len(change_sizes)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias = v[:-1], v[-1]
        logit = bias + _text.segment_sums(w[features], ends)
        value = float(weights @ (np.logaddexp(0, logit) - labels * logit)) + 0.5 * l2 * float(w @ w)
        wrong = weights * (1 / (1 + np.exp(-logit)) - labels)
        slope = np.bincount(features, weights=np.repeat(wrong, sizes), minlength=n_features)[:n_features] + l2 * w
        if changes:
            moved = _text.segment_sums(w[change_feature] * change_sign, change_ends)
            value += swap_weight * float(moved @ moved) / changes
            slope = slope + 2 * swap_weight / changes * np.bincount(change_feature, weights=change_sign * np.repeat(moved, change_sizes), minlength=n_features)[:n_features]
        return value, np.append(slope, wrong.sum())

    share = float(weights @ labels / weights.sum()) if weights.sum() else 0.5
    share = min(max(share, 1e-4), 1 - 1e-4)
    v = minimise(loss, np.append(np.zeros(n_features), np.log(share / (1 - share))))
    return v[:-1], float(v[-1])


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 10_000, bits: int = 18, n_features: int = 8192, l2: float = 2e-4, swap_weight: float = 1.0, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> Model:
    """Fit on at most ``max_rows`` rows of ``labels`` of either class, joined to their texts by ``key``."""
    known = labels.select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("label")).where("key is not null and label is not null")
    share = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    empty = Model(bits, np.full(1 << bits, -1, dtype=np.int64), np.zeros(1))
    if len(share) < 2:
        ones, zeros = share.get(1, 0) + 0.5, share.get(0, 0) + 0.5
        empty.bias = float(np.log(ones / zeros))
        return empty
    chosen = None
    for k in (0, 1):  # at most max_rows keys a class: that bounds what is broadcast
        own = known.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(max_rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "key").select("text", "label")
    counts = _document_counts(sample, bits)

    def rows_of(kept: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _text.slices(batch, "text"):
                    label = part.column("label").to_pylist()
                    owner, feature = features_of(part.column("text"), kept, bits)
                    split = np.split(feature, np.searchsorted(owner, np.arange(1, len(label))))
                    out = [(k, own.astype("<i4").tobytes(), b"") for k, own in zip(label, split)]
                    for text in part.column("text").to_pylist():
                        pairs = list(dict.fromkeys(swapped_sentences(text, groups)))
                        if pairs:
                            out += _changes(pairs, kept, bits)
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["label", "a", "b"])

        return run

    found = [int(counts_k) for counts_k in (share[0], share[1])]
    n = np.array([min(max_rows, x) for x in found], dtype=np.float64)
    kept = _select(counts, np.maximum(n, counts.max(axis=1)), n_features, bits)
    size = int((kept >= 0).sum())
    y, sizes, change_sizes = [], [], []
    parts, change_parts, signs = bytearray(), bytearray(), bytearray()  # one buffer each, not an object a row
    neutral = neutral_pairs(groups)
    for label_, a, b in chain(sample.mapInArrow(rows_of(kept), "label int, a binary, b binary").toLocalIterator(), _changes(neutral, kept, bits) if neutral else ()):
        n_a, n_b = len(a) // 4, len(b) // 4
        if label_ >= 0:
            y.append(label_)
            sizes.append(n_a)
            parts += a
        elif n_a or n_b:
            change_sizes.append(n_a + n_b)
            change_parts += a
            change_parts += b
            signs += b"\x01" * n_a + b"\xff" * n_b
    if not y or not size:
        empty.bias = float(np.log((found[1] + 0.5) / (found[0] + 0.5)))
        return empty
    labels_ = np.array(y, dtype=np.float64)
    ones = labels_.sum()
    if 0 < ones < len(y):
        weights = np.where(labels_ > 0, found[1] / ones, found[0] / (len(y) - ones)) / sum(found)
    else:
        weights = np.full(len(y), 1 / len(y))
    held = np.array(sizes), np.frombuffer(parts, "<i4")
    changed = np.array(change_sizes, dtype=np.int64), np.frombuffer(change_parts, "<i4"), np.frombuffer(signs, np.int8)
    w, bias = fit(*held, labels_, weights, *changed, size, l2, swap_weight)
    return Model(bits, kept, w, bias)


def score(docs: DataFrame, model: Model, *, text: str = "text", score_name: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher the likelier the text is labelled toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _text.appended(docs, lambda texts: [pa.array(shared.value.scores(texts), pa.float64())], {score_name: "double"}, text)
