"""Registered queries of archives: a hundred documents to an archive, written and read back by range."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.queries import _table, query
from leafmill.sources import members
from leafmill.sources.tables import shared_folder, written

PACKED = "packed AS (SELECT doc_id // 100 AS archive, CASE doc_id % 5 WHEN 0 THEN '.hidden/' WHEN 1 THEN '__MACOSX/' ELSE '' END || lang || '/scan ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.JPG' END AS name, text FROM documents)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of archives made from all documents, with their archive's number."""
    folder = F.when(F.col("doc_id") % 5 == 0, ".hidden/").when(F.col("doc_id") % 5 == 1, "__MACOSX/").otherwise("")
    name = F.concat(folder, "lang", F.lit("/scan "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".JPG"))
    path = F.concat(F.lit(f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".zip"))
    rows = _table(spark, sf_dir, "documents").select(path.alias("path"), name.alias("name"), F.col("text").cast("binary").alias("content"))
    packed = written(members.pack(rows, level=1), "packed")
    return members.members(packed).withColumn("archive", F.regexp_extract("path", r"([0-9]+)\.zip$", 1).cast("bigint"))


@query(f"WITH {PACKED} SELECT archive, name, CAST(strlen(text) AS BIGINT) AS size FROM packed")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of archives, read by range."""
    return _members(spark, sf_dir).select("archive", "name", "size")


@query(f"""WITH {PACKED}, shown AS (SELECT *, CAST(regexp_extract(name, 'scan ([0-9]+)', 1) AS BIGINT) AS n FROM packed WHERE NOT starts_with(name, '.') AND NOT starts_with(name, '__') AND ends_with(name, '.JPG')),
placed AS (SELECT *, row_number() OVER w AS page, sum(strlen(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM shown WINDOW w AS (PARTITION BY archive ORDER BY lower(regexp_extract(name, '^[^/]*', 0)), n))
SELECT archive, name, CAST(page AS INT) AS page, CASE WHEN used <= 60000 THEN sha256(text) END AS sha256, used > 60000 AS over_budget FROM placed""")
def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of comic archives in natural order; only those within the budget are read."""
    pages = members.contents(members.images(_members(spark, sf_dir), 60_000))
    return pages.select("archive", "name", "page", F.sha2("content", 256).alias("sha256"), F.col("error").isNotNull().alias("over_budget"))
