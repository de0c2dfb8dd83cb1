"""Recognition of scanned pages as a plan: what needs it, once per content, through a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import batches
from leafmill.sources.tables import written

Recogniser = Callable[[bytes], str]


def needed(pages: DataFrame, *, force: bool = False) -> DataFrame:
    """Pages ``(doc, page, text)`` without a text layer; all of them if forced."""
    return pages if force else pages.where(~text.has_text_layer(F.col("text")))


def cache_key(image: Column, *settings: str) -> Column:
    """Key of a recognition: its settings and the image's bytes."""
    return text.content_key(*(F.lit(s) for s in settings), image)


def each(recogniser: Recogniser) -> Callable[[DataFrame], DataFrame]:
    """``(key, payload, error)`` of rows ``(key, image)`` by a function of one image, tried once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for key, image in zip(part.column("key").to_pylist(), part.column("image").to_pylist()):
                try:
                    out.append((key, recogniser(image), None))
                except Exception as error:
                    out.append((key, None, f"{type(error).__name__}: {error}"))
            keys, texts, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["key", "payload", "error"])

    return lambda missing: missing.mapInArrow(run, "key string, payload string, error string")


def recognised(images: DataFrame, cache: DataFrame, recognise: Callable[[DataFrame], DataFrame], *, settings: tuple[str, ...] = ("v1",)) -> tuple[DataFrame, DataFrame]:
    """(pages with ``recognised`` text, new cache rows) of images ``(doc, page, image)`` against a cache ``(key, payload)``.

    ``recognise`` turns ``(key, image)`` into ``(key, payload, error)``: ``each`` of a
    function, or a service behind a gate (``services.chat_recogniser``).  Keys travel, not
    images: each missing content is recognised once, whichever pages show it, and
    failures are cached by nobody.  Answers are written before both results read them,
    so a service is asked once.
    """
    keyed = images.withColumn("key", cache_key(F.col("image"), *settings))
    missing = keyed.groupBy("key").agg(F.first("image").alias("image")).join(cache.select("key"), "key", "left_anti")
    made = written(recognise(missing).select("key", "payload", "error"), "recognised")
    known = cache.select("key", "payload", F.lit(None).cast("string").alias("error")).unionByName(made)
    pages = keyed.select("doc", "page", "key").join(known, "key", "left").select("doc", "page", F.col("payload").alias("recognised"), "error")
    return pages, made.where("error is null").select("key", "payload")


def texts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc, text)``: the pages' own or recognised texts, joined in order; blank ones are left out."""
    whole = batches.with_recognised(pages, found.select("doc", "page", "recognised"))
    shown = whole.where(F.trim("text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return shown.groupBy("doc").agg(F.array_join(ordered, "\n\n").alias("text"))
