"""Registered queries of graphs and trees of objects.

A customer is a document here; its objects are its orders (pages) and their lines.  An
order leads to its first line, a line to the next one unless it was returned, and some
lines to the next or the previous order, so there are loops, lost objects and shared ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import graphs, naming
from leafmill.plans.queries import _table, query
from leafmill.sources import inputs
from leafmill.sources.tables import written

OBJECTS = """
sheets AS (SELECT o_custkey AS doc, CAST(o_orderkey AS BIGINT) * 64 AS object, o_orderstatus AS status, o_orderpriority AS priority,
  lead(CAST(o_orderkey AS BIGINT) * 64) OVER w AS following, lag(CAST(o_orderkey AS BIGINT) * 64) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
rows AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS number FROM lineitem),
lines AS (SELECT doc, object + number AS object, object AS sheet, following, previous, number, l_returnflag AS flag, 'm' || (l_partkey % 7) AS mode, l_quantity AS quantity, l_suppkey AS supplier
  FROM rows JOIN sheets ON object = CAST(l_orderkey AS BIGINT) * 64),
objects AS (SELECT doc, object FROM sheets UNION ALL SELECT doc, object FROM lines),
edges AS (SELECT doc, object, 0 AS place, object + 1 AS ref FROM sheets
  UNION ALL SELECT doc, object, 1, object + 1 FROM lines WHERE flag <> 'R'
  UNION ALL SELECT doc, object, 2, following FROM lines WHERE quantity > 30 AND following IS NOT NULL
  UNION ALL SELECT doc, object, 3, previous FROM lines WHERE mode = 'm1' AND previous IS NOT NULL
  UNION ALL SELECT doc, object, 4, -CAST(supplier AS BIGINT) FROM lines WHERE mode = 'm2'),
roots AS (SELECT doc, min(object) AS object FROM sheets GROUP BY doc)"""
REACHED = "reached AS (SELECT doc, object FROM roots UNION SELECT e.doc, e.ref FROM reached r JOIN edges e ON e.doc = r.doc AND e.object = r.object)"
TREE = """
tree AS (SELECT doc, object AS node, previous AS parent, CASE WHEN status = 'F' THEN priority END AS value, CASE WHEN status <> 'P' THEN status || object END AS name FROM sheets
  UNION ALL SELECT doc, object, CASE WHEN number = 1 THEN sheet ELSE object - 1 END, CASE WHEN quantity > 45 THEN mode END, mode FROM lines)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order (``number`` null) and each line; lines are joined by the key that they are numbered by, so they are shuffled once."""
    row, order = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey").cast("bigint") * 64
    sheets = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("l_orderkey"), order.alias("sheet"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lead(order).over(row).alias("following"), F.lag(order).over(row).alias("previous")
    )
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    mode = F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string"))
    line = F.struct(number.alias("number"), F.col("l_returnflag").alias("flag"), mode.alias("mode"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("supplier"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line"))
    # an order stands beside its first line, so that one join gives both
    none = F.lit(None).cast(lines.schema["line"].dataType)
    both = F.when(F.coalesce(F.col("line.number"), F.lit(1)) == 1, F.array(none, F.col("line"))).otherwise(F.array(F.col("line")))
    rows = sheets.join(lines, "l_orderkey", "left").withColumn("lone", F.col("line").isNull()).select("*", F.posexplode(both).alias("at", "row"))
    rows = rows.where(~F.col("lone") | (F.col("at") == 0)).select("doc", "sheet", "status", "priority", "following", "previous", "row.*")
    return rows.withColumn("object", F.col("sheet") + F.coalesce("number", F.lit(0)))


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, edges, sheets)"""
    line = F.col("number").isNotNull()
    refs = [
        F.when(~line, F.col("object") + 1),
        F.when(F.col("flag") != "R", F.col("object") + 1),
        F.when(F.col("quantity") > 30, F.col("following")),
        F.when(F.col("mode") == "m1", F.col("previous")),
        F.when(F.col("mode") == "m2", -F.col("supplier").cast("bigint")),
    ]
    rows = written(_rows(spark, sf_dir).select("doc", "object", line.alias("line"), F.array(*refs).alias("refs")), "structure")
    edges = rows.select("doc", "object", F.posexplode("refs").alias("place", "ref")).where("ref is not null")
    return rows.select("doc", "object"), edges, rows.where("not line").select("doc", "object")


def _first(sheets: DataFrame) -> DataFrame:
    return sheets.groupBy("doc").agg(F.min("object").alias("object"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("number").isNotNull()
    name = F.when(F.col("status") != "P", F.concat("status", F.col("object").cast("string")))
    above = F.when(F.col("number") == 1, F.col("sheet")).otherwise(F.col("object") - 1)
    value = F.when(line, F.when(F.col("quantity") > 45, F.col("mode"))).when(F.col("status") == "F", F.col("priority"))
    return _rows(spark, sf_dir).select("doc", F.col("object").alias("node"), F.when(line, above).otherwise(F.col("previous")).alias("parent"), value.alias("value"), F.when(line, F.col("mode")).otherwise(name).alias("name"))


@query(f"WITH RECURSIVE {OBJECTS}, {REACHED} SELECT r.doc, r.object FROM reached r JOIN objects o ON o.doc = r.doc AND o.object = r.object")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that a document's root leads to."""
    objects, edges, sheets = _objects(spark, sf_dir)
    return graphs.reachable(edges, _first(sheets), objects=objects)


@query(f"""WITH RECURSIVE {OBJECTS}, {REACHED},
kept AS (SELECT r.doc, r.object, row_number() OVER (PARTITION BY r.doc ORDER BY r.object) AS number FROM reached r JOIN objects o ON o.doc = r.doc AND o.object = r.object)
SELECT e.doc, k.number, e.place, t.number AS target FROM edges e JOIN kept k ON k.doc = e.doc AND k.object = e.object LEFT JOIN kept t ON t.doc = e.doc AND t.object = e.ref""")
def pruned_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between the objects that are kept, under their new numbers."""
    objects, edges, sheets = _objects(spark, sf_dir)
    return graphs.pruned(objects, edges, _first(sheets))[1]


@query(f"""WITH RECURSIVE {OBJECTS}, inner_edges AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM sheets s WHERE s.doc = e.doc AND s.object = e.ref)),
reached AS (SELECT object AS page, doc, object FROM sheets UNION SELECT r.page, e.doc, e.ref FROM reached r JOIN inner_edges e ON e.doc = r.doc AND e.object = r.object)
SELECT r.page, r.doc, r.object FROM reached r JOIN objects o ON o.doc = r.doc AND o.object = r.object""")
def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page needs to stand in a file of its own."""
    return graphs.page_objects(*_objects(spark, sf_dir))


@query(f"""WITH RECURSIVE {OBJECTS}, {TREE},
up AS (SELECT doc, node, parent, value, 0 AS levels FROM tree UNION ALL SELECT u.doc, u.node, t.parent, t.value, levels + 1 FROM up u JOIN tree t ON t.doc = u.doc AND t.node = u.parent WHERE u.value IS NULL AND levels < 100)
SELECT t.doc, t.node, u.value, CAST(u.levels AS INT) AS levels FROM tree t LEFT JOIN (SELECT * FROM up WHERE value IS NOT NULL) u ON u.doc = t.doc AND u.node = t.node""")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute of each node, or that of the nearest ancestor which has it."""
    return graphs.inherited(written(_tree(spark, sf_dir).drop("name"), "structure"))


@query(f"""WITH RECURSIVE {OBJECTS}, {TREE},
down AS (SELECT doc, node, name AS "full", 1 AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.doc, t.node, CASE WHEN d."full" IS NULL THEN t.name WHEN t.name IS NULL THEN d."full" ELSE d."full" || '.' || t.name END, depth + 1 FROM down d JOIN tree t ON t.doc = d.doc AND t.parent = d.node WHERE depth < 32)
SELECT t.doc, t.node, d."full", CAST(d.depth AS INT) AS depth FROM tree t LEFT JOIN down d ON d.doc = t.doc AND d.node = t.node""")
def full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nodes with those of their ancestors, and their levels."""
    return graphs.full_names(written(_tree(spark, sf_dir).drop("value"), "structure"))


FOUND = "found AS (SELECT DISTINCT '/data/' || source || '/' || CASE WHEN doc_id % 9 = 0 THEN '~$' ELSE '' END || 'scan ' || (doc_id % 50) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xyz' WHEN 2 THEN '' ELSE '.jpg' END AS path FROM documents)"


@query(f"""WITH {FOUND},
places AS (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS arg FROM documents),
known AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM found WHERE (path LIKE '%.PDF' OR path LIKE '%.jpg') AND path NOT LIKE '%/~$%'),
hits AS (
  SELECT arg, 0 AS line, path, NULL AS pages FROM places JOIN known ON arg % 5 = 0 AND dir = '/data/' || source
  UNION ALL SELECT arg, 1, path, '2-3' FROM places JOIN known ON arg % 5 = 1 AND dir = '/data/' || source AND regexp_matches(name, '^scan 1[^/]*\\.PDF$')
  UNION ALL SELECT arg, 2, path, 'odd' FROM places JOIN known ON arg % 5 = 2 AND regexp_matches(path, '^/data/[^/]*/scan [78]\\.jpg$')
  UNION ALL SELECT arg, 3, '/data/' || source || '/none.pdf', '1' FROM places WHERE arg % 5 = 3
  UNION ALL SELECT arg, 4, path, 'odd' FROM places JOIN known ON arg % 5 = 4 AND dir = '/data/' || source AND regexp_matches(name, '^scan .\\.jpg$'))
SELECT arg, row_number() OVER (PARTITION BY arg ORDER BY line, CAST(regexp_extract(path, 'src([0-9]+)', 1) AS INT), CAST(coalesce(nullif(regexp_extract(path, 'scan ([0-9]+)', 1), ''), '0') AS INT), lower(path)) AS seq, path, pages FROM hits""")
def expanded_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, globs, plain names and relative entries of lists against the files that are there."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    ending = F.element_at(F.array(F.lit(".PDF"), F.lit(".xyz"), F.lit(""), F.lit(".jpg")), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "source", F.when(F.col("doc_id") % 9 == 0, "/~$scan ").otherwise("/scan "), (F.col("doc_id") % 50).cast("string"), ending)
    arg = F.substring("source", 4, 9).cast("int")
    folder = F.concat(F.lit("/data/"), "source")
    kinds = [
        (F.concat(folder, F.lit("/")), F.lit(""), None),
        (F.concat(folder, F.lit("/scan 1*.PDF:2-3")), F.lit(""), None),
        (F.lit("/data/*/scan [78].jp?"), F.lit(""), "odd"),
        (F.lit("none.pdf:1"), folder, "odd"),
        (F.lit("scan ?.jpg"), folder, "odd"),
    ]
    rows = [F.struct(F.lit(n).cast("bigint").alias("line"), entry.alias("entry"), base.alias("base"), F.lit(pages).cast("string").alias("pages")) for n, (entry, base, pages) in enumerate(kinds)]
    entries = docs.select("source", arg.alias("arg")).distinct().select("arg", F.element_at(F.array(*rows), F.col("arg") % 5 + 1).alias("e")).select("arg", "e.*")
    return inputs.expanded(entries, docs.select(path.alias("path")))


OUTPUTS = "outputs AS (SELECT doc_id AS nth, '/o/scan' || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 11 = 1 THEN '_2_' || (doc_id % 4) ELSE '_' || (doc_id % 17) END || CASE doc_id % 5 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '' ELSE '.pdf' END AS path FROM documents)"


@query(rf"""WITH RECURSIVE {OUTPUTS},
cut AS (SELECT *, regexp_extract(path, '(\.[^./]*)$', 1) AS ending, row_number() OVER (PARTITION BY regexp_extract(path, '(\.[^./]*)$', 1) ORDER BY nth) AS n FROM outputs),
split AS (SELECT *, left(path, length(path) - length(ending)) AS stem FROM cut),
walk AS (
  SELECT DISTINCT ending, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS nth, [CAST('/o/scan_3.pdf' AS VARCHAR)] AS taken, CAST(NULL AS VARCHAR) AS file FROM split
  UNION ALL
  SELECT ending, n, nth, list_append(taken, file), file FROM (
    SELECT s.ending, s.n, s.nth, w.taken, CASE WHEN NOT list_contains(w.taken, s.path) THEN s.path ELSE
      list_filter(list_transform(range(2, len(w.taken) + 3), lambda k: s.stem || '_' || k || s.ending), lambda p: NOT list_contains(w.taken, p))[1] END AS file
    FROM walk w JOIN split s ON s.ending = w.ending AND s.n = w.n + 1))
SELECT nth, file FROM walk WHERE nth IS NOT NULL""")
def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output paths made unique in order, where a third of the rows want one name and others want its numbered forms."""
    n = F.col("doc_id")
    name = F.when(n % 3 == 0, "").when(n % 11 == 1, F.concat(F.lit("_2_"), (n % 4).cast("string"))).otherwise(F.concat(F.lit("_"), (n % 17).cast("string")))
    ending = F.element_at(F.array(*map(F.lit, (".tar.gz", "", ".pdf", ".pdf", ".pdf"))), (n % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select(n.alias("nth"), F.concat(F.lit("/o/scan"), name, ending).alias("path"))
    existing = spark.createDataFrame([("/o/scan_3.pdf",)], "path string")
    return naming.unique_paths(rows, "path", "nth", existing).select("nth", "file")
