"""Image files as JPEGs, as pages and as PDF files: rows ``(path, content)`` in, errors as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import pixels
from leafmill.operators.rows import gathered
from leafmill.sources import frames, jpeg, pdf, rasters

A4 = (595.276, 841.89)


def decoded(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, width, height, channels, data)`` of a folder's JPEG, PNG, GIF and BMP files, by Spark's own image source.

    Pictures are first frames as stored, blue before green before red; files that
    cannot be decoded are left out.
    """
    found = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("image.origin").alias("path"), *(F.col(f"image.{old}").alias(new) for old, new in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))))


def as_array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """A row of ``decoded`` as pixels in the order of red, green, blue (and transparency)."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image[..., 0] if channels == 1 else image[..., [2, 1, 0, *range(3, channels)]]


def pictures_of(rows: DataFrame, path: str, data: str, width: int = 64) -> DataFrame:
    """``(path, content)``: bytes as gray PNG files of a width, the last row filled up with zeros; null and empty ones are one row of zeros."""

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name, raw in zip(batch.column("path"), batch.column("content")):
                held = raw.as_py() or b"\0"
                held += b"\0" * (-len(held) % width)
                yield {"path": name.as_py(), "content": rasters.png_file(np.frombuffer(held, np.uint8).reshape(-1, width))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(made(batches), schema)

    return rows.select(F.col(path).cast("string").alias("path"), F.col(data).cast("binary").alias("content")).mapInArrow(run, "path string, content binary")


def pixel_bytes(files: DataFrame) -> DataFrame:
    """``(path, page, width, height, channels, data, error)``: the pixels of each frame, row by row."""

    def of(raw: bytes) -> Iterator[dict]:
        for i, image in enumerate(frames.frames(raw)):
            yield {"page": i + 1, "width": image.shape[1], "height": image.shape[0], "channels": 1 if image.ndim == 2 else image.shape[2], "data": image.tobytes()}

    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
    return _rows(files, schema, "path string, page int, width int, height int, channels int, data binary, error string", of)


def _sized(image: np.ndarray, sheet: tuple[float, float] | None, dpi: int) -> np.ndarray:
    """No larger than a sheet asks for at a resolution, whichever way the picture lies; 0 leaves it."""
    h, w = image.shape[:2]
    if sheet is None or not dpi:
        return image
    long, short = (max(1, int(s * dpi / 72 + 0.5)) for s in sorted(sheet, reverse=True))
    scale = min(1.0, long / max(w, h), short / min(w, h))
    return image if scale >= 1 else pixels.resized(image, *(max(1, int(n * scale + 0.5)) for n in (w, h)))


def to_jpegs(raw: bytes, *, quality: int = 85, sheet: tuple[float, float] | None = None, dpi: int = 300) -> Iterator[bytes]:
    """A JPEG for each frame of a file; one that is a JPEG stays as it is, but for private metadata."""
    if raw[:2] == b"\xff\xd8":
        yield rasters.strip_jpeg(raw)
        return
    for image in frames.frames(raw):
        yield jpeg.encode(_sized(image, sheet, dpi), quality)


def image_document(raw: bytes, *, sheet: tuple[float, float] | None = A4, quality: int = 85, dpi: int = 300) -> pdf.Document:
    """A PDF with a page for each frame; without a sheet, pages are pictures at the resolution that the file records."""
    own = rasters.dpi(raw) if sheet is None else None
    return pdf.merge([pdf.from_jpeg(made, sheet, own) for made in to_jpegs(raw, quality=quality, sheet=sheet, dpi=dpi)])


def _rows(files: DataFrame, schema: pa.Schema, kinds: str, of: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """A row for each that ``of`` yields; one with an error, after those before it, where it fails."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content")):
                name = path.as_py()
                try:
                    for row in of(raw.as_py() or b""):
                        yield {"path": name, **row}
                except Exception as error:  # one bad file is a row, not the end of the job
                    yield {"path": name, "error": f"{type(error).__name__}: {error}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(made(batches), schema)

    return files.select("path", "content").mapInArrow(run, kinds)


def jpeg_pages(files: DataFrame, **options) -> DataFrame:
    """``(path, page, width, height, content, error)``: a JPEG for each frame, from 1."""

    def of(raw: bytes) -> Iterator[dict]:
        for i, made in enumerate(to_jpegs(raw, **options)):
            found = rasters.jpeg_at(made)
            if found is None:
                raise ValueError("not a whole JPEG file")
            yield {"page": i + 1, "width": found[1], "height": found[2], "content": made}

    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
    return _rows(files, schema, "path string, page int, width int, height int, content binary, error string", of)


def image_documents(files: DataFrame, **options) -> DataFrame:
    """``(path, content, pages, error)``: each image file as a PDF; a file with a frame that fails makes none."""

    def of(raw: bytes) -> Iterator[dict]:
        made = image_document(raw, **options)
        yield {"content": pdf.save(made), "pages": len(made.pages())}

    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("pages", pa.int32()), ("error", pa.string())])
    return _rows(files, schema, "path string, content binary, pages int, error string", of)


def fitted(pictures: DataFrame, limit: int, quality: int = 85) -> DataFrame:
    """``(path, content, quality, error)`` of rows of ``decoded``: the best JPEG of at most ``limit`` bytes."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("quality", pa.int32()), ("error", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, *picture in zip(*(batch.column(c) for c in ("path", "data", "width", "height", "channels"))):
                row = {"path": path.as_py()}
                try:
                    row["content"], row["quality"] = jpeg.fit(as_array(*(x.as_py() for x in picture)), limit, quality)
                except Exception as error:
                    row["error"] = f"{type(error).__name__}: {error}"
                yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(made(batches), schema)

    return pictures.mapInArrow(run, "path string, content binary, quality int, error string")
