"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder if driver and tasks are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="leafmill-")
        shared_folder.own = folder
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; ``options`` are the writer's.

    This cuts the lineage at a copy that outlives any executor, and gives joins
    plain scans on both sides, whose skewed partitions adaptive execution splits.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, for use in executors, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put_file(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """Write under a name of its own and rename, so that a lost or doubled task leaves whole files only."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)
