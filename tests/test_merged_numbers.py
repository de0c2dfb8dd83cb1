import re

import duckdb
from pyspark.sql import functions as F

from leafmill.operators import pages
from leafmill.plans.queries import _lines

WHOLE = """WITH l AS (SELECT doc_id AS doc, len(string_split(text, chr(10))) AS n FROM '{0}/documents.parquet' WHERE text IS NOT NULL),
o AS (SELECT doc, n, coalesce(sum(n) OVER (ORDER BY doc DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT doc, unnest(range(1, n + 1)) AS page, CAST(page + off AS BIGINT) FROM o"""


def test_all_documents_are_numbered_without_one_ordered_task(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc", "page")
    merged = pages.merge_documents(rows, rows.select("doc").distinct().withColumn("seq", -F.col("doc")))
    got = sorted((r.doc, r.page, r.merged_page) for r in merged.collect())
    assert got == sorted(duckdb.connect().execute(WHOLE.format(sf_dir)).fetchall())
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(seq", plan)


def test_numbers_follow_text_orders_and_equal_places(spark):
    rows = spark.createDataFrame([(d, p) for d in range(300) for p in range(1, d % 4 + 2)], "doc int, page int")
    place = {d: None if d == 7 else f"s{d * 37 % 100:02d}" for d in range(300)}
    merged = pages.merge_documents(rows, spark.createDataFrame(list(place.items()), "doc int, seq string"))
    got = [(r.doc, r.page) for r in sorted(merged.collect(), key=lambda r: r.merged_page)]
    assert got == sorted(((r.doc, r.page) for r in rows.collect()), key=lambda x: (place[x[0]] or "", *x))
    assert sorted(r.merged_page for r in merged.collect()) == list(range(1, len(got) + 1))
