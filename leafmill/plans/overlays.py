"""Registered queries of layers of words over images, and of files that are public all at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import overlays, sinks
from leafmill.plans.queries import LINES, _lines, _table, query
from leafmill.sources.tables import shared_folder

# Advances are multiples of 1/1024, so their sums are exact in any order.
_ADVANCE = "CASE WHEN c BETWEEN 32 AND 126 THEN (300 + c * 7 % 500) / 1024.0 ELSE 0.5 END"


@query(f"""WITH {LINES}, w AS (SELECT doc, page AS pos, text || ' ' AS shown, CAST(page // 2 % 3 AS DOUBLE) AS line_y, greatest(2 + page % 4 * 3, 3 + page % 5, 4) AS size FROM lines WHERE regexp_matches(text, '[^\\s\\pZ]')),
objects AS (SELECT *, sum(CASE WHEN old = line_y THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos) AS object FROM (SELECT *, lag(line_y) OVER (PARTITION BY doc ORDER BY pos) AS old FROM w)),
codes AS (SELECT shown, unnest(list_transform(string_split(shown, ''), lambda x: unicode(x))) AS c, unnest(range(1, length(shown) + 1)) AS i FROM (SELECT DISTINCT shown FROM w)),
widths AS (SELECT shown, sum(CAST({_ADVANCE} AS DOUBLE)) AS ems, string_agg(printf('%04X', CASE WHEN c BETWEEN 32 AND 126 THEN c - 29 ELSE 0 END), '' ORDER BY i) AS glyphs FROM codes GROUP BY shown)
SELECT doc, pos, CAST(object AS BIGINT) AS object, CAST(size AS DOUBLE) AS size, 500.0 - line_y - size * 0.75::DOUBLE AS baseline, (length(o.shown) * 3 + pos)::DOUBLE / (ems * size) * 100 AS stretch, md5(glyphs) AS glyphs
FROM objects o JOIN widths t ON t.shown = o.shown""")
def searchable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, sizes and stretching of words over a page, here of the lines of texts."""
    pos = F.col("page")
    words = _lines(spark, sf_dir).select(
        "doc",
        pos.alias("pos"),
        "text",
        (pos * 2).cast("double").alias("x"),
        (F.floor(pos / 2) % 3).cast("double").alias("line_y"),
        (pos % 4 * 3 + 2).cast("double").alias("line_height"),
        (pos % 5 + 3).cast("double").alias("height"),
        ((F.length("text") + 1) * 3 + pos).cast("double").alias("width"),
        F.lit(500.0).alias("area_height"),
    )
    font = spark.range(32, 127).select(F.char("id").alias("character"), (F.col("id") - 29).cast("int").alias("glyph"), ((F.col("id") * 7 % 500 + 300) / 1024.0).alias("advance"))
    placed = overlays.placed_words(words, font, 0.75)
    return placed.select("doc", "pos", F.col("object").cast("bigint").alias("object"), "size", "baseline", "stretch", F.md5("glyphs").alias("glyphs"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def committed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts written as files that become public at once, read back through the commit."""
    target = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"
    path = F.concat(F.lit(f"{target}/texts/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    sinks.write_all(_table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content")), target)
    found = sinks.contents(sinks.committed(spark, target))
    return found.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"), "bytes", F.sha2("content", 256).alias("sha256"))
