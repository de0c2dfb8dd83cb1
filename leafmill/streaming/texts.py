"""The text readers over a folder that fills up, with exactly-once output.

Files are a stream of ``binaryFile`` rows; each micro-batch goes through the batch
reader.  The checkpoint remembers which files are done, and the Parquet sink's log
which outputs count, so a restart neither repeats nor loses one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources import documents


def incoming(spark: SparkSession, folder: str, *, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """``(path, modificationTime, length, content)`` of files as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)


def write_texts(files: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Texts of arriving files as a Parquet table; ``trigger`` as for ``writeStream`` (all that is there, by default)."""
    texts = documents.read_texts(files)
    return texts.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def arrivals(files: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by window of their modification time; windows close when they are ``late`` past."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", width)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
