"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of characters (code points, orders 1 to 3, lower-cased) per
language over every labelled text, in ``2 ** bits`` hash buckets.  Each task sums its own texts into one
dense vector per language, and the vectors are added up by language and slice, so
what meets in one task has a fixed size.  The log-probability matrix (buckets by
languages) is broadcast after its size is checked against ``max_model_bytes``.
Scoring gathers matrix rows for all n-grams of a batch at once and sums them by row.

Defined results: texts that are null or hold no letter are ``und`` with score 0;
rows with a null language teach nothing; with no labelled row at all every text is
``und``; equal likelihoods take the alphabetically first language.  The score is the
posterior of the predicted language under a uniform prior, with the evidence scaled
down to that of at most ``evidence`` n-grams, so long texts do not all score 1.  It
tells learned languages apart; whether a text is of any of them at all is told by its
likelihood per n-gram, against the mean of that in the learned texts (``like_name``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _text

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
UNLIKE = 4.0
_SLICES = 8


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # (2 ** bits, languages), float32
    bits: int
    orders: tuple[int, ...]


def _grams(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    try:
        column = pc.utf8_lower(pc.fill_null(column, ""))
    except pa.ArrowInvalid:
        pass  # bytes that are no UTF-8 have no case
    for codes, pointers in _text.row_grams(*_text.characters(*_text.utf8(column)), orders):
        yield (codes >> np.uint32(32 - bits)).astype(np.int64), pointers


def gram_counts(labelled: DataFrame, text: str, language: str, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """Rows ``(name, slice, counts)``: n-gram counts by language as little-endian int64 vectors."""
    width = (1 << bits) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _text.slices(batch, "text"):
                names = part.column("language").to_pylist()
                order = {x: i for i, x in enumerate(sorted(set(names)))}
                row = np.array([order[x] for x in names])
                for codes, pointers in _grams(part.column("text"), orders, bits):
                    owner = np.repeat(row, np.diff(pointers))
                    for name, i in order.items():
                        own = held.setdefault(name, np.zeros(1 << bits, dtype=np.int64))
                        own += np.bincount(codes[owner == i], minlength=1 << bits)
        for name, own in held.items():
            yield _text.vector_rows([(name, i, own[i * width : (i + 1) * width]) for i in range(_SLICES)])

    rows = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(language).cast("string").alias("language"))
    return _text.summed_vectors(rows.mapInArrow(count, _text.VECTOR_ROWS), width)


def train(labelled: DataFrame, *, text: str = "text", language: str = "lang", bits: int = 16, orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5, max_model_bytes: int = 256 << 20) -> Model:
    """Fit the model on every row with a text and a language."""
    sums: dict[str, np.ndarray] = {}
    width = (1 << bits) // _SLICES
    for row in gram_counts(labelled, text, language, bits, orders).toLocalIterator():
        own = sums.setdefault(row.name, np.zeros(1 << bits, dtype=np.int64))
        own[row.slice * width : (row.slice + 1) * width] += np.frombuffer(bytes(row.counts), "<i8")
        if len(sums) * (4 << bits) > max_model_bytes:
            raise ValueError(f"over {max_model_bytes} bytes of log-probabilities; use fewer bits")
    languages = sorted(sums)
    counts = np.array([sums[x] for x in languages], dtype=np.float64).reshape(len(languages), 1 << bits) + smoothing
    matrix = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return Model(languages, np.ascontiguousarray(matrix.T, dtype=np.float32), bits, orders)


def _has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = _text.utf8(column)
    lowered = _text.LOWER[data]
    letters = np.concatenate([[0], np.cumsum((lowered >= 97) & (lowered < 123))])
    found = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in (column[i].as_py() or ""))
    return found


def _totals(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text in each language, and its n-grams."""
    total, grams = np.zeros((len(column), len(model.languages))), np.zeros(len(column))
    for codes, pointers in _grams(column, model.orders, model.bits):
        total += _text.segment_sums(model.log_probability[codes], pointers)
        grams += np.diff(pointers)
    return total, grams


def _like(total: np.ndarray, grams: np.ndarray, model: Model) -> np.ndarray:
    chance = np.exp(model.log_probability.astype(np.float64))
    mean = (chance * model.log_probability).sum(axis=0)
    spread = np.sqrt(np.maximum((chance * model.log_probability.astype(np.float64) ** 2).sum(axis=0) - mean**2, 0))
    n, best = np.maximum(grams, 1), total.argmax(axis=1)
    return total[np.arange(len(total)), best] / n >= mean[best] - UNLIKE - 3 * spread[best] / np.sqrt(n)


def resembles(column: pa.Array, model: Model, totals: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Whether each text is at most UNLIKE nats an n-gram (and 3 standard errors) less likely than learned texts.

    Ids and numbers are of no language: a text that fails is judged again without words that hold a digit.
    """
    if not model.languages:
        return np.zeros(len(column), dtype=bool)
    out = _like(*(totals or _totals(column, model)), model)
    failed = np.flatnonzero(~out)
    if len(failed):
        rest = pc.replace_substring_regex(pc.fill_null(column.take(pa.array(failed)), ""), r"\S*[0-9]\S*", "")
        out[failed] = _like(*_totals(rest, model), model)
    return out


def score(column: pa.Array, model: Model, evidence: float, totals: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    rows = len(column)
    if not model.languages:
        return [UNDETERMINED] * rows, np.zeros(rows)
    total, grams = totals or _totals(column, model)
    scaled = total * np.minimum(1.0, evidence / np.maximum(grams, 1))[:, None]
    scaled -= scaled.max(axis=1, keepdims=True)
    posterior = np.exp(scaled)
    posterior /= posterior.sum(axis=1, keepdims=True)
    best, known = total.argmax(axis=1), _has_letter(column)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, posterior[np.arange(rows), best], 0.0)


def predict(docs: DataFrame, model: Model, *, text: str = "text", evidence: float = 60.0, pred: str = "lang_pred", score_name: str = "lang_score", like_name: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score, and under ``like_name`` whether it resembles learned texts; the names of the new columns are free."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(texts: pa.Array) -> list[pa.Array]:
        totals = _totals(texts, shared.value)
        names, scores = score(texts, shared.value, evidence, totals)
        like = [pa.array(resembles(texts, shared.value, totals))] if like_name else []
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), *like]

    return _text.appended(docs, made, {pred: "string", score_name: "double"} | ({like_name: "boolean"} if like_name else {}), text)


def crc_fold(key: str, parts: int) -> Column:
    """crc32 of a key's text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts
