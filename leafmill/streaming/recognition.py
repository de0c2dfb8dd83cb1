"""Recognition of arriving images, each content once, into a cache that any number of writers share.

Requests ``(key, image, asked_at)`` arrive in a folder that anybody may add files to.  Each
of ``shards`` streams owns the keys that hash to it, so no two writers ever ask for one
content, and none needs a lock.  Within ``late`` of its last request a key is let through
once (its state is in the checkpoint); after that the cache knows it, or it failed and may
be tried again.  Every micro-batch writes a folder of its own, named by its number: a batch
that was written before the stream died is not asked for again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import batches

REQUEST = "key string, image binary, asked_at timestamp"
ENTRY = "key string, payload string, error string"


def _written(spark: SparkSession, folder: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _entries(spark: SparkSession, cache: str) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], f"{ENTRY}, shard int, batch bigint")
    return spark.read.schema(f"{ENTRY}, shard int, batch bigint").parquet(cache)


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """``(key, payload)`` of all recognised contents."""
    return _entries(spark, cache).where("error is null").select("key", "payload")


def failures(spark: SparkSession, cache: str) -> DataFrame:
    """``(key, error)`` of contents that no batch has recognised."""
    entries = _entries(spark, cache)
    failed = entries.where("error is not null").groupBy("key").agg(F.max_by("error", "batch").alias("error"))
    return failed.join(entries.where("error is null").select("key"), "key", "left_anti")


def requests(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """The stream of request files (Parquet) in a folder."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def recognise(asked: DataFrame, cache: str, checkpoint: str, recogniser: Callable[[DataFrame], DataFrame], *, shard: int = 0, shards: int = 1, late: str = "1 hour", **trigger) -> StreamingQuery:
    """Start one shard's stream; ``recogniser`` turns ``(key, image)`` into ``(key, payload, error)``."""
    own = asked.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard)
    once = own.withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["key"])

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        folder = f"{cache}/shard={shard}/batch={number}"
        if _written(spark, folder):
            rows.write.format("noop").mode("overwrite").save()  # the state of its keys is still to be kept
            return
        known = _entries(spark, cache).where((F.col("shard") == shard) & F.col("error").isNull()).select("key")
        missing = rows.groupBy("key").agg(F.first("image").alias("image")).join(known, "key", "left_anti")
        recogniser(missing).select("key", "payload", "error").write.mode("overwrite").parquet(folder)

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def report(results: DataFrame, log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Progress of arriving results ``(name, error, outputs)`` as an event log in JSON lines, a folder for each batch.

    Each batch logs a line for each result and one with the totals so far, which are the
    last batch's totals and its own.  A batch that is run again writes the same folder
    anew, so the log after any number of restarts is that of an unbroken run.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        ok = F.col("error").isNull()
        told = rows.select(batches.event(F.when(ok, "info").otherwise("error"), F.lit("result"), F.coalesce("error", F.concat(F.lit("written "), "name")), F.struct("name", "outputs")).alias("value"))
        totals = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.coalesce(F.sum(F.when(ok, F.col("outputs"))), F.lit(0)).cast("bigint").alias("outputs"))
        if number and _written(spark, f"{log}/totals/batch={number - 1}"):
            totals = totals.union(spark.read.schema(totals.schema).json(f"{log}/totals/batch={number - 1}"))
        totals = totals.agg(*(F.sum(c).alias(c) for c in ("total", "succeeded", "outputs")))
        totals.coalesce(1).write.mode("overwrite").json(f"{log}/totals/batch={number}")
        so_far = spark.read.schema(totals.schema).json(f"{log}/totals/batch={number}")
        line = batches.event(F.lit("info"), F.lit("progress"), F.concat_ws(" of ", "succeeded", "total"), F.struct("total", "succeeded", "outputs"))
        told.union(so_far.select(line.alias("value"))).write.mode("overwrite").text(f"{log}/events/batch={number}")

    return results.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
