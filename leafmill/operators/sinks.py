"""Files written from rows: each under a name of its own, then renamed; one by one, or all or none."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from leafmill.operators.batches import conflicts


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(uri))


def write_files(outputs: DataFrame, *, force: bool = False) -> DataFrame:
    """Write rows ``(path, content)`` and return ``(path, bytes, error)`` for each.

    All destinations are checked first: two rows with one destination stop the write
    before any file is made.  An existing file is an error of its row unless forced.
    """
    if not conflicts(outputs.select("path"), "path").isEmpty():
        raise ValueError("several rows would write the same file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    fs, at = filesystem(path)
                    if not force and fs.get_file_info(at).type != pafs.FileType.NotFound:
                        raise FileExistsError(path)
                    fs.create_dir(at.rpartition("/")[0] or ".", recursive=True)
                    part = f"{at}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as sink:
                        sink.write(content or b"")
                    fs.move(part, at)
                    out.append((path, len(content or b""), None))
                except Exception as error:
                    out.append((path, None, f"{type(error).__name__}: {error}"))
            paths, sizes, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["path", "bytes", "error"])

    return outputs.select("path", "content").mapInArrow(run, "path string, bytes bigint, error string")


#: Folders of a target of ``write_all``: files that are not public yet, and what makes them so.
STAGED, MANIFESTS = "_staged", "_manifests"
_STAGED = "path string, staged string, bytes bigint, error string"


def _staged(outputs: DataFrame, folder: str, force: bool) -> DataFrame:
    """``(path, staged, bytes, error)`` of rows ``(path, content)`` written under ``folder`` by the digest of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                content, error = content or b"", None
                place = f"{folder}/{hashlib.sha256(path.encode()).hexdigest()}"
                try:
                    target, at = filesystem(path)
                    if not force and target.get_file_info(at).type != pafs.FileType.NotFound:
                        raise FileExistsError(path)
                    fs, at = filesystem(place)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    part = f"{at}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as sink:
                        sink.write(content)
                    fs.move(part, at)
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([place], pa.string()), pa.array([len(content)], pa.int64()), pa.array([error], pa.string())], names=["path", "staged", "bytes", "error"])

    return outputs.select("path", "content").mapInArrow(run, _STAGED)


def write_all(outputs: DataFrame, target: str, *, force: bool = False) -> str:
    """Write all rows ``(path, content)`` or none, and return the commit's name.

    Files are staged under ``target`` first, with a table that lists them.  If a row
    fails, two rows have one destination, or (unless forced) a destination exists or an
    earlier commit has it, nothing is public and an error is raised.  Else a manifest of
    one line, which names the table, is renamed into place: that makes all files public
    to ``committed`` and ``publish``, and nothing before it does.
    """
    spark = outputs.sparkSession
    if not conflicts(outputs.select("path"), "path").isEmpty():
        raise ValueError("several rows would write the same file")
    if not force:
        earlier = committed(spark, target).select("path")
        if not outputs.select("path").join(earlier, "path", "left_semi").isEmpty():
            raise FileExistsError("an earlier commit has one of the files")
    commit = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    folder = f"{target.rstrip('/')}/{STAGED}/{commit}"
    _staged(outputs, f"{folder}/files", force).write.parquet(f"{folder}/index")
    failed = spark.read.schema(_STAGED).parquet(f"{folder}/index").where("error is not null").select("error").first()
    if failed:
        raise OSError(f"nothing was written: {failed.error}")
    _commit(target, commit)
    return commit


def _commit(target: str, commit: str) -> None:
    fs, at = filesystem(f"{target.rstrip('/')}/{MANIFESTS}")
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/.{commit}.part") as sink:
        sink.write(commit.encode())
    fs.move(f"{at}/.{commit}.part", f"{at}/{commit}")


def committed(spark: SparkSession, target: str) -> DataFrame:
    """``(path, staged, bytes, commit)`` of all files that commits made public; of several commits of one path the last counts."""
    fs, at = filesystem(f"{target.rstrip('/')}/{MANIFESTS}")
    commits = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if not f.base_name.startswith("."))
    if not commits:
        return spark.createDataFrame([], "path string, staged string, bytes bigint, commit string")
    index = spark.read.schema(_STAGED).parquet(*(f"{target.rstrip('/')}/{STAGED}/{c}/index" for c in commits))
    told = index.select("path", "staged", "bytes", F.regexp_extract("staged", rf"/{STAGED}/([^/]+)/", 1).alias("commit"))
    return told.groupBy("path").agg(F.max_by(F.struct("staged", "bytes", "commit"), "commit").alias("f")).select("path", "f.*")


def contents(files: DataFrame) -> DataFrame:
    """Rows of ``committed`` with ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, place in enumerate(batch.column("staged").to_pylist()):
                fs, at = filesystem(place)
                with fs.open_input_stream(at) as source:
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([source.read()], pa.binary())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(run, StructType([*files.schema, StructField("content", BinaryType())]))


def publish(spark: SparkSession, target: str) -> DataFrame:
    """``(path, bytes, error)``: every public file put at its own path, each by a rename.  Run again after a failure, it does what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                error = None
                try:
                    fs, at = filesystem(path)
                    fs.create_dir(at.rpartition("/")[0] or ".", recursive=True)
                    part = f"{at}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as sink:
                        sink.write(content.as_buffer())
                    fs.move(part, at)
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([len(content.as_buffer())], pa.int64()), pa.array([error], pa.string())], names=["path", "bytes", "error"])

    return contents(committed(spark, target)).mapInArrow(run, "path string, bytes bigint, error string")
