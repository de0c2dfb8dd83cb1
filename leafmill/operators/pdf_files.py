"""Whole-document operators on PDF files: rows ``(path, content)`` in, rows out, errors as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.rows import gathered
from leafmill.sources import pdf, pdf_merge

PAGE_ROW = "path string, page int, width double, height double, rotation int, fonts int, images int, text string, error string"


def pages(files: DataFrame, failed: str | None = None) -> DataFrame:
    """A row for each page with its displayed size, counts and text; a file that cannot be read is one row with an error.

    ``failed`` names a column of earlier errors: where it is not null the file is not read, and its row has that error.
    """

    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("rotation", pa.int32()), ("fonts", pa.int32()), ("images", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, raw, before in zip(*batch.columns):
                name = path.as_py()
                if before.is_valid:
                    yield {"path": name, "error": before.as_py()}
                    continue
                try:
                    rows = [{"path": name, **r} for r in pdf.page_rows(pdf.load(raw.as_py() or b""))]
                except Exception as error:
                    rows = [{"path": name, "error": f"{type(error).__name__}: {error}"}]
                yield from rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(made(batches), schema)

    before = F.col(failed) if failed else F.lit(None)
    return files.select("path", "content", before.cast("string").alias("before")).mapInArrow(run, PAGE_ROW)


def edited(files: DataFrame, edit: Callable[[pdf.Document], pdf.Document | None]) -> DataFrame:
    """``(path, content, error)`` after an edit; None from it leaves a file out, and an exception is its row's error."""

    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content")):
                made, error = None, None
                try:
                    doc = edit(pdf.load(raw.as_py() or b""))
                    made = None if doc is None else pdf.save(doc)
                except Exception as failure:
                    error = f"{type(failure).__name__}: {failure}"
                if made is not None or error:
                    yield {"path": path.as_py(), "content": made, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(rows(batches), schema)

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


def merged(files: DataFrame, group: str, order: str) -> DataFrame:
    """``(group, content, files)``: the documents of each group as one, in order.

    A merged file is one value, so a group is as large as its file and goes to one task.
    """

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by(order)
        docs = [pdf.load(raw) for raw in rows.column("content").to_pylist()]
        return pa.table({group: pa.array([key[0].as_py()], rows.schema.field(group).type), "content": pa.array([pdf.save(pdf_merge.merge(docs))], pa.binary()), "files": pa.array([len(docs)], pa.int32())})

    kind = files.schema[group].dataType.simpleString()
    return files.select(group, order, "content").groupBy(group).applyInArrow(merge, f"`{group}` {kind}, content binary, files int")


def from_texts(rows: DataFrame, path: str, text: str, **layout) -> DataFrame:
    """``(path, content)``: each text as a PDF file."""

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name, body in zip(batch.column("path"), batch.column("text")):
                yield {"path": name.as_py(), "content": pdf.save(pdf.from_text(body.as_py() or "", **layout))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(made(batches), schema)

    return rows.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, content binary")
