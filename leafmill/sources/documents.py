"""Files as DataFrames: lists and folders of inputs, and the text of any readable document with an error column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import names
from leafmill.sources import archives
from leafmill.sources.encoding import decode_text
from leafmill.sources.html import html_to_text

_READERS = {
    "text": decode_text,
    "html": lambda raw: html_to_text(decode_text(raw)),
    "word": archives.office_text,
    "excel": archives.office_text,
    "powerpoint": archives.office_text,
    "epub": archives.epub_text,
    "fb2": archives.fb2_file_text,
    "htmlz": archives.htmlz_text,
}


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(line, entry)`` of an input list: blank lines, ``#`` comments and a byte-order mark left out."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")
    listed = whole.select(F.posexplode(lines).alias("line", "entry")).select("line", F.regexp_replace("entry", r"(?U)^\s+|\s+$", "").alias("entry"))
    return listed.where((F.col("entry") != "") & ~F.col("entry").startswith("#"))


def input_specs(entries: DataFrame, default_pages: Column | None = None) -> DataFrame:
    """``(line, path, pages)`` of entries; an entry's own page range goes before that of its list."""
    path, pages = names.split_page_range(F.col("entry"))
    return entries.select("line", path.alias("path"), F.coalesce(pages, default_pages if default_pages is not None else F.lit(None).cast("string")).alias("pages"))


def list_files(spark: SparkSession, folder: str, command: str = "merge", pattern: str = "*") -> DataFrame:
    """``(seq, path, format)`` of a folder's files that a command admits, in natural order.

    Names are filtered before any content is looked at (the scan prunes it).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    known = names.with_format(files.where(~names.is_lock_file(F.col("path")))).where("format is not null")
    if command in names.ADMITTED:
        known = known.where(F.col("format").isin(*names.ADMITTED[command]))
    from leafmill.operators.batches import ranked

    return ranked(known.select("path", "format"), [names.natural_key(F.col("path")), F.col("path")], "seq").select("seq", "path", "format")


def read_texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, format, text, error)`` of files ``(path, content)``; a file that cannot be read has an error, not a text."""
    rows = names.with_format(files.select(F.col(path).alias("path"), F.col(content).alias("content"))).select("path", "format", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, raw in zip(batch.column("format").to_pylist(), batch.column("content").to_pylist()):
                raw = raw or b""
                kind = kind or archives.kind_of(raw) or "text"
                try:
                    if kind not in _READERS:
                        raise archives.Unreadable(f"no text reader for {kind}")
                    out.append((kind, _READERS[kind](raw), None))
                except Exception as error:  # one bad file is a row, not the end of the job
                    out.append((kind, None, f"{type(error).__name__}: {error}"))
            kinds, texts, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "format", "text", "error"])

    return rows.mapInArrow(run, "path string, format string, text string, error string")
