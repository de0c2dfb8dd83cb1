"""Registered queries of the document operators, each with SQL that checks it.

The test tables hold no PDF or raster, so page operators run on the lines of texts as
pages, and image operators on columns derived from ``lineitem``, ``part`` and
``embeddings``; the derivation is the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry, names, parsers, recognition, text
from leafmill.operators import batches, images, markup, pages, pdf_files, raster_files
from leafmill.plans import html_sql
from leafmill.plans import recognition as recognition_plans
from leafmill.sources import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.lines_as_pages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


LINES = "lines AS (SELECT doc_id AS doc, CAST(i AS INT) AS page, l[i] AS text, CAST(len(l) AS INT) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query(html_sql.HTML_TEXT)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of the pages."""
    shown = markup.with_text(_table(spark, sf_dir, "pages").select("page_id", "html"))
    return shown.select("page_id", "text", F.length("text").alias("n_chars"), text.has_text_layer(F.col("text")).alias("has_text"))


@query(html_sql.HTML_BLOCKS)
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' text blocks, in order."""
    return markup.blocks(_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


_ENTITY_CASES = ", ".join(f"'{k}': {v}" for k, v in text.ENTITIES.items())


@query(f"""
WITH t AS (SELECT page_id, html, regexp_extract_all(html, '(?s)&[^;&]{{0,32}};|&|[^&]+') AS ts FROM pages),
u AS (SELECT page_id, unnest(range(1, len(ts) + 1)) AS i, ts FROM t),
v AS (SELECT page_id, i, ts[i] AS tok, regexp_extract(ts[i], '(?s)^&(.*);$', 1) AS name FROM u),
w AS (SELECT page_id, i, tok, coalesce(
        CASE WHEN regexp_matches(name, '^#[0-9]+$') THEN chr(CAST(substr(name, 2) AS INT)) END,
        CASE WHEN regexp_matches(name, '^#[xX][0-9a-fA-F]+$') THEN chr(CAST('0x' || substr(name, 3) AS INT)) END,
        chr(CAST(MAP {{{_ENTITY_CASES}}}[name] AS INT)), tok) AS out FROM v)
SELECT page_id, md5(string_agg(CASE WHEN starts_with(tok, '&') THEN out ELSE tok END, '' ORDER BY i)) AS decoded, CAST(sum(CASE WHEN starts_with(tok, '&') THEN 1 ELSE 0 END) AS BIGINT) AS marks
FROM w GROUP BY page_id
""")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character references decoded in raw pages."""
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.decode_entities(F.col("html")).cast("binary")).alias("decoded"), (F.length("html") - F.length(F.replace("html", F.lit("&")))).cast("bigint").alias("marks"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\s\\pZ]', '', 'g')) >= 100 AS has_text, CAST(length(regexp_replace(text, '[\\s\\pZ]', '', 'g')) AS BIGINT) AS visible FROM documents")
def text_layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.has_text_layer(F.col("text")).alias("has_text"), text.visible_characters(F.col("text")).cast("bigint").alias("visible"))


@query("SELECT doc_id, length(text) > 0 AND NOT contains(text, chr(0)) AS is_text FROM documents")
def text_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose bytes look like text (all are UTF-8, or Latin-1 words where cut inside a character)."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.looks_like_text(F.col("text").cast("binary")).alias("is_text"))


@query("SELECT doc_id, sha256(concat('v1', lang, text)) AS key FROM documents")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.lit("v1"), F.col("lang"), F.col("text")).alias("key"))


_CACHE = "cache AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 3 = 0)"


@query(f"WITH {_CACHE} SELECT sha256(text) AS key, min(doc_id) AS first_doc, count(*) AS users FROM documents WHERE sha256(text) NOT IN (SELECT key FROM cache) GROUP BY 1")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents to recognise, each once, that the cache lacks."""
    wanted, cache = _cache(spark, sf_dir)
    return batches.cache_misses(wanted, cache)


@query(f"WITH {_CACHE} SELECT doc_id, sha256(text) AS key FROM documents WHERE sha256(text) IN (SELECT key FROM cache)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, cache = _cache(spark, sf_dir)
    return wanted.join(cache, "key", "left_semi").select("doc_id", "key")


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.col("text")).alias("key"))
    return docs, docs.where("doc_id % 3 = 0").select("key").distinct()


_PLAUSIBLE = """
words AS (SELECT {id}, unnest(list_filter(regexp_split_to_array(text, '[\\s\\pZ]+'), lambda w: w <> '')) AS w FROM {table}),
parts AS (SELECT {id}, regexp_replace(unnest(string_split(w, '-')), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS p FROM words),
good AS (SELECT {id}, sum(CASE WHEN length(p) >= 3 AND ((regexp_full_match(p, '[0-9.,/:%]*') AND length(regexp_replace(p, '[^0-9]', '', 'g')) >= 2)
   OR (regexp_full_match(p, '[A-Za-z]+') AND regexp_matches(lower(p), '[aeiouy]'))) THEN length(p) ELSE 0 END) AS plausible FROM parts GROUP BY {id}),
seen AS (SELECT {id}, sum(length(w)) AS total FROM words GROUP BY {id})"""


@query(f"WITH {_PLAUSIBLE.format(id='doc_id', table='documents')} SELECT doc_id, CAST(coalesce(plausible, 0) AS BIGINT) AS plausible, CAST(coalesce(total, 0) AS BIGINT) AS total FROM documents LEFT JOIN good USING (doc_id) LEFT JOIN seen USING (doc_id)")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in plausible words, and all."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.plausibility(F.col("text")).alias("p")).select("doc_id", F.col("p.plausible").cast("bigint").alias("plausible"), F.col("p.total").cast("bigint").alias("total"))


@query(f"""WITH turns AS (SELECT conv_id * 1000 + turn AS tid, conv_id, turn, text FROM conversations), {_PLAUSIBLE.format(id='tid', table='turns')}
SELECT conv_id, arg_max(turn, (coalesce(plausible, 0) / greatest(total, 1)) * 1e9 - turn) AS turn FROM turns LEFT JOIN good USING (tid) LEFT JOIN seen USING (tid) GROUP BY conv_id""")
def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several readings, the one of the highest plausibility; the earliest of equals."""
    p = text.plausibility(F.col("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("p"))
    share = F.col("p.plausible") / F.greatest("p.total", F.lit(1))
    return rows.groupBy("conv_id").agg(F.max_by("turn", share * 1e9 - F.col("turn")).alias("turn"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text, ' ' || chr(10)) ELSE text || chr(10) || chr(10) || '*[Warning: the model''s answer was cut off by the token limit]*' END AS answer, turn % 2 = 0 AS complete FROM conversations""")
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without reasoning blocks, which are put in before (even turns) or left open behind (odd turns)."""
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>a\nb</think>\n"), F.col("text"))).otherwise(F.concat("text", F.lit("<think>never closed")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_think(raw).alias("s")).select("conv_id", "turn", "s.answer", "s.complete")


@query("""
WITH p AS (SELECT doc_id, i AS line, string_split(l[i], ' | ') AS parts FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
e AS (SELECT doc_id, line, CASE WHEN len(parts) = 1 THEN parts[1] ELSE list_reduce(parts, lambda a, x: a || repeat(' ', CAST(8 - length(a) % 8 AS BIGINT)) || x) END AS t FROM p)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY line)) AS expanded FROM e GROUP BY doc_id""")
def expand_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs (put in for table bars) widened to columns of eight."""
    tabbed = F.replace("text", F.lit(" | "), F.lit("\t"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.expand_tabs(tabbed).cast("binary")).alias("expanded"))


_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower({x}), '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 10, '0') || ltrim(t, '0') || lpad(CAST(length(t) AS VARCHAR), 10, '0') ELSE t END), '')"


@query(f"SELECT page_id, url, row_number() OVER (ORDER BY {_NATURAL.format(x='url')}, page_id) AS place FROM pages")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in natural order, with their places."""
    return batches.ranked(_table(spark, sf_dir, "pages").select("page_id", "url"), [names.natural_key(F.col("url")), F.col("page_id")], "place")


def _selection(expression: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pages.select_pages(_lines(spark, sf_dir), expression)


#: (list, SQL condition on n, SQL list of pages) of each selection.
_SELECTIONS = {
    "all": ("all", "n >= 1", "range(1, n + 1)"),
    "even": ("even", "n >= 2", "range(2, n + 1, 2)"),
    "odd": ("odd", "n >= 1", "range(1, n + 1, 2)"),
    "reverse": ("reverse", "n >= 1", "list_reverse(range(1, n + 1))"),
    "ranges": ("2-3,-2,last-1,3-", "n >= 3", "list_concat([2, 3], [1, 2], list_reverse(range(1, n + 1)), range(3, n + 1))"),
    "repeats": ("3,1-2,3, L ,first", "n >= 3", "list_concat([3, 1, 2, 3], [n, 1])"),
}
for _name, (_expression, _when, _list) in _SELECTIONS.items():
    QUERIES[f"select_pages_{_name}"] = _selection(_expression)
    ORACLE_SQL[f"select_pages_{_name}"] = f"""WITH {LINES}, d AS (SELECT DISTINCT doc, n FROM lines WHERE {_when}), p AS (SELECT doc, {_list} AS ps FROM d),
    q AS (SELECT doc, CAST(i AS INT) AS pos, CAST(ps[i] AS INT) AS page FROM (SELECT doc, ps, unnest(range(1, len(ps) + 1)) AS i FROM p))
    SELECT doc, pos, page, text FROM q JOIN lines USING (doc, page)"""


@query(f"WITH {LINES} SELECT doc, page, text FROM lines WHERE NOT (page % 3 = 0)")
def drop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return pages.drop_pages(rows, rows.where("page % 3 = 0").select("doc", "page"))


@query(f"WITH {LINES} SELECT doc, page, text FROM lines WHERE page <= 2")
def keep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return pages.keep_pages(rows, rows.where("page <= 2").select("doc", "page"))


@query(f"WITH {LINES}, m AS (SELECT *, length(text) < 40 AS blank FROM lines), a AS (SELECT *, bool_and(blank) OVER (PARTITION BY doc) AS every FROM m) SELECT doc, page, text FROM a WHERE NOT blank OR every")
def remove_blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of under 40 characters go, unless a document has no others."""
    return pages.remove_blank(_lines(spark, sf_dir), F.length("text") < 40)


@query(f"WITH {LINES}, s AS (SELECT * FROM lines WHERE page % 2 = 1) SELECT doc, page, 'Page ' || (4 + row_number() OVER (PARTITION BY doc ORDER BY page)) || ' of ' || (4 + count(*) OVER (PARTITION BY doc)) AS label FROM s")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.number_pages(_lines(spark, sf_dir).where("page % 2 = 1").select("doc", "page"), "Page {n} of {total}", 5)


@query(f"WITH {LINES} SELECT doc, page, CAST((page - 1) // 60 + 1 AS INT) AS sheet, CAST((page - 1) % 60 + 1 AS INT) AS row FROM lines")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paginate(_lines(spark, sf_dir).select("doc", "page"))


@query(f"WITH {LINES} SELECT doc, page, doc || '_' || lpad(CAST(page AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INT), '0') || '.pdf' AS file FROM lines")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_names(_lines(spark, sf_dir).select("doc", "page"))


@query("SELECT source, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS merged, count(*) AS parts FROM documents GROUP BY source")
def merge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each source joined in order."""
    merged = pages.merge_text(_table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return merged.select("source", F.md5(F.col("merged").cast("binary")).alias("merged"), "parts")


@query(f"""WITH {LINES}, c AS (SELECT *, sum(n1) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM (SELECT doc, any_value(n) AS n1 FROM lines GROUP BY doc))
SELECT doc, page, CAST(page + coalesce(off, 0) AS BIGINT) AS merged_page FROM lines JOIN c USING (doc)""")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers in one merged document."""
    rows = _lines(spark, sf_dir).select("doc", "page")
    return pages.merge_documents(rows, rows.select("doc").distinct().withColumn("seq", F.col("doc"))).select("doc", "page", F.col("merged_page").cast("bigint").alias("merged_page"))


@query(f"WITH {LINES} SELECT doc, string_agg(page, ',' ORDER BY page) AS removed FROM lines WHERE page % 3 = 0 GROUP BY doc")
def removed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removed pages of each document, as reports name them."""
    gone = _lines(spark, sf_dir).where("page % 3 = 0").groupBy("doc").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    return gone.select("doc", names.number_list(F.col("pages")).alias("removed"))


_BOXES = "boxes AS (SELECT doc, page AS pos, text, CAST((page * 37) % 5 AS DOUBLE) * 100 AS x, CAST(page // 3 AS DOUBLE) * 30 + CAST(page % 3 AS DOUBLE) * 2.5 AS y, CAST(20 + page % 2 AS DOUBLE) AS height FROM lines)"


@query(f"""WITH {LINES}, {_BOXES}, m AS (SELECT *, y + height / 2 AS centre FROM boxes),
g AS (SELECT *, CASE WHEN abs(centre - lag(centre) OVER w) < 0.35 * greatest(height, lag(height) OVER w) THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc ORDER BY centre, pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY centre, pos ROWS UNBOUNDED PRECEDING) AS row FROM g),
l AS (SELECT doc, row, string_agg(text, chr(9) ORDER BY x, centre, pos) AS line FROM r GROUP BY doc, row)
SELECT doc, md5(string_agg(line, chr(10) ORDER BY row)) AS text, count(*) AS rows FROM l GROUP BY doc""")
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages laid out from recognised lines."""
    page = F.col("page")
    boxes = _lines(spark, sf_dir).select(
        "doc", page.alias("pos"), "text", (page * 37 % 5).cast("double").__mul__(100).alias("x"), (F.floor(page / 3).cast("double") * 30 + (page % 3).cast("double") * 2.5).alias("y"), (20 + page % 2).cast("double").alias("height")
    )
    return pages.layout_rows(boxes).select("doc", F.md5(F.col("text").cast("binary")).alias("text"), "rows")


_SHEETS = "sheets AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS page, 0.0 AS l, 0.0 AS b, 100.0 + l_quantity AS r, 100.0 + l_partkey % 50 AS t, (l_suppkey % 4) * 90 AS rot FROM lineitem)"
_SHOWN = "shown AS (SELECT *, CASE WHEN rot % 180 = 90 THEN t - b ELSE r - l END AS w, CASE WHEN rot % 180 = 90 THEN r - l ELSE t - b END AS h FROM sheets)"
_MAJOR = "votes AS (SELECT doc, sum(CASE WHEN w > h THEN 1 ELSE -1 END) AS v, arg_min(w > h, page) AS first FROM shown GROUP BY doc), major AS (SELECT doc, CASE WHEN v = 0 THEN first ELSE v > 0 END AS landscape FROM votes)"


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("page"), F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), (100.0 + F.col("l_quantity")).alias("r"), (100.0 + F.col("l_partkey") % 50).alias("t"), ((F.col("l_suppkey") % 4) * 90).alias("rot")
    )
    return rows, geometry.is_landscape(*(F.col(c) for c in ("l", "b", "r", "t", "rot")))


@query(f"WITH {_SHEETS}, {_SHOWN}, {_MAJOR} SELECT doc, landscape FROM major")
def majority_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, landscape = _sheets(spark, sf_dir)
    return pages.majority_landscape(rows, landscape)


@query(f"WITH {_SHEETS}, {_SHOWN}, {_MAJOR} SELECT doc, page, CASE WHEN (w > h) <> landscape THEN (rot + 270) % 360 ELSE rot END AS rotation FROM shown JOIN major USING (doc)")
def auto_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that lie otherwise than most turned by a quarter."""
    rows, landscape = _sheets(spark, sf_dir)
    joined = rows.withColumn("own", landscape).join(pages.majority_landscape(rows, landscape), "doc")
    return joined.select("doc", "page", F.when(F.col("own") != F.col("landscape"), geometry.turned(F.col("rot"), -90)).otherwise(F.col("rot")).alias("rotation"))


@query(f"""WITH {_SHEETS} SELECT doc, page,
CAST(CASE rot WHEN 90 THEN 7.0 WHEN 180 THEN (r - l) - 5 WHEN 270 THEN (t - b) - 7 ELSE 5.0 END AS DOUBLE) AS x, CAST(CASE rot WHEN 90 THEN (r - l) - 5 WHEN 180 THEN (t - b) - 7 WHEN 270 THEN 5.0 ELSE 7.0 END AS DOUBLE) AS y,
CAST(5.0 AS DOUBLE) AS back_x, CAST(7.0 AS DOUBLE) AS back_y FROM sheets""")
def point_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page point on the displayed page, and mapped back."""
    rows, _ = _sheets(spark, sf_dir)
    box = [F.col(c) for c in ("l", "b", "r", "t", "rot")]
    x, y = geometry.page_to_display(F.lit(5.0), F.lit(7.0), *box)
    shown = rows.withColumns({"x": x, "y": y})
    back_x, back_y = geometry.display_to_page(F.col("x"), F.col("y"), *box)
    return shown.select("doc", "page", "x", "y", back_x.alias("back_x"), back_y.alias("back_y"))


_PIXELS = "px AS (SELECT vec_id AS doc, i, CAST(floor(abs(e[i]) * 255) AS INT) % 256 AS value FROM (SELECT vec_id, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.floor(F.abs("e") * 255) % 256).cast("int")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.posexplode("embedding").alias("i", "e")).select("doc", (F.col("i") + 1).alias("i"), level.alias("value"))


@query(f"WITH {_PIXELS}, p AS (SELECT doc, CAST(quantile_disc(value, 0.5) AS INT) AS paper FROM px GROUP BY doc) SELECT doc, any_value(paper) AS paper, avg(CASE WHEN abs(value - paper) > 50 THEN 1.0 ELSE 0.0 END) <= 0.0025 AS blank FROM px JOIN p USING (doc) GROUP BY doc")
def blank_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.blank_sheets(_pixels(spark, sf_dir))


@query(f"""WITH {_PIXELS}, n AS (SELECT doc, value, count(*) AS n FROM px GROUP BY doc, value),
s AS (SELECT doc, value, sum(n) OVER (PARTITION BY doc ORDER BY value) AS up, sum(n) OVER (PARTITION BY doc ORDER BY value DESC) AS down, floor(sum(n) OVER (PARTITION BY doc) / 100) AS cut FROM n),
f AS (SELECT doc, min(CASE WHEN up > cut THEN value END) AS low, max(CASE WHEN down > cut THEN value END) AS high FROM s GROUP BY doc)
SELECT doc, low, high, high >= low + 32 AS stretched FROM f""")
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.contrast_range(_pixels(spark, sf_dir))


@query(f"WITH {_PIXELS} SELECT doc, value AS level, count(*) AS n FROM px GROUP BY doc, value")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).groupBy("doc", F.col("value").alias("level")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PIXELS}, c AS (SELECT doc, value AS r, (value * 7 + i) % 256 AS g, (value + 3) % 256 AS b FROM px)
SELECT doc, count(DISTINCT (r, g, b)) AS colours, count(DISTINCT (r, g, b)) <= 256 AS few_colours,
count(*) FILTER (WHERE greatest(r, g, b) - least(r, g, b) > 24) <= floor(count(*) / 5000) AS gray FROM c GROUP BY doc""")
def few_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir).select("doc", F.col("value").alias("r"), ((F.col("value") * 7 + F.col("i")) % 256).alias("g"), ((F.col("value") + 3) % 256).alias("b"))
    return images.colour_classes(px)


@query(f"WITH {_PIXELS} SELECT doc, CAST(i AS INT) AS i, (77 * value + 150 * ((value * 7) % 256) + 29 * (255 - value) + 128) >> 8 AS luma, CAST(floor((value * (i % 256) + 255 * (255 - i % 256) + 127) / 255) AS INT) AS over_white, CAST(floor((255 - value) * (255 - i % 256) / 255) AS INT) AS from_cmyk FROM px")
def pixel_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, i = F.col("value"), F.col("i") % 256
    return _pixels(spark, sf_dir).select("doc", "i", geometry.luma(v, v * 7 % 256, 255 - v).alias("luma"), geometry.over_white(v, i).alias("over_white"), geometry.from_cmyk(v, i).alias("from_cmyk"))


_DRAWN = "d AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS image, l_linenumber * 1000000 + l_partkey AS page, l_linenumber AS draw_pos, l_quantity AS width, CAST(l_partkey % 40 AS DOUBLE) AS height, l_quantity * (l_partkey % 40) AS area FROM lineitem)"


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 3).alias("image"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("page"), F.col("l_linenumber").alias("draw_pos"), F.col("l_quantity").alias("width"), (F.col("l_partkey") % 40).cast("double").alias("height"), (F.col("l_quantity") * (F.col("l_partkey") % 40)).alias("area")
    )


@query(f"WITH {_DRAWN}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, image ORDER BY area DESC, page, draw_pos) AS k FROM d) SELECT doc, image, page, draw_pos, area FROM r WHERE k = 1")
def largest_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.largest_drawing(_drawings(spark, sf_dir))


@query(f"WITH {_DRAWN} SELECT doc, image, max(width) AS width, max(height) AS height FROM d GROUP BY doc, image")
def drawn_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.drawn_extent(_drawings(spark, sf_dir))


@query(f"WITH {_DRAWN}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, image ORDER BY width DESC, page) AS k FROM d) SELECT doc, image, page, CAST(width AS BIGINT) AS target_width, CAST(height AS BIGINT) AS target_height FROM r WHERE k = 1")
def image_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_targets(_drawings(spark, sf_dir).select("doc", "image", "page", F.col("width").cast("bigint").alias("target_width"), F.col("height").cast("bigint").alias("target_height")))


_PICTURES = "pics AS (SELECT doc, page % 2 AS page, page AS image, page AS pos, area FROM d)"


@query(f"WITH {_DRAWN}, {_PICTURES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY area DESC, pos DESC) AS k FROM pics) SELECT doc, page, image, area FROM r WHERE k = 1")
def largest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.largest_image(_pictures(spark, sf_dir))


@query(f"""WITH {_DRAWN}, {_PICTURES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY area DESC, pos) AS k, count(*) OVER (PARTITION BY doc, page) AS n FROM pics WHERE area >= 100)
SELECT doc, page, image, 'page_' || page || CASE WHEN n > 1 THEN '_image_' || k ELSE '' END AS label FROM r""")
def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.labelled_images(_pictures(spark, sf_dir), 100).select("doc", "page", "image", "label")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawings(spark, sf_dir).select("doc", (F.col("page") % 2).alias("page"), F.col("page").alias("image"), F.col("page").alias("pos"), "area")


_PARTS = "pt AS (SELECT p_partkey, p_size * 60 AS w, (p_partkey % 97 + 1) * 30 AS h FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60).alias("w"), ((F.col("p_partkey") % 97 + 1) * 30).alias("h"))


@query(f"""WITH {_PARTS}, s AS (SELECT *, least(800.0 / w, 600.0 / h) AS k FROM pt)
SELECT p_partkey, CASE WHEN w > 800 OR h > 600 THEN CAST(greatest(round(w * k), 1) AS BIGINT) END AS width, CASE WHEN w > 800 OR h > 600 THEN CAST(greatest(round(h * k), 1) AS BIGINT) END AS height FROM s""")
def fit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", geometry.fit_dimensions(F.col("w"), F.col("h"), F.lit(800.0), F.lit(600.0)).alias("d")).select("p_partkey", "d.*")


@query(f"""WITH {_PARTS}, o AS (SELECT *, (w > h) AS land, 210.0 * 72.0 / 25.4 AS a, 297.0 * 72.0 / 25.4 AS b FROM pt),
s AS (SELECT *, CASE WHEN land THEN b ELSE a END AS pw, CASE WHEN land THEN a ELSE b END AS ph FROM o), k AS (SELECT *, least(pw / w, ph / h) AS k FROM s)
SELECT p_partkey, pw AS page_width, ph AS page_height, (pw - w * k) / 2 AS x, (ph - h * k) / 2 AS y, w * k AS width, h * k AS height FROM k""")
def image_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _parts(spark, sf_dir).select("p_partkey", geometry.image_placement(F.col("w"), F.col("h")).alias("p")).select("p_partkey", "p.*")
    return placed.select("p_partkey", *((F.round(c, 6) + 0.0).alias(c) for c in placed.columns[1:]))


ORACLE_SQL["image_placement"] = "SELECT p_partkey, round(page_width, 6) AS page_width, round(page_height, 6) AS page_height, round(x, 6) + CAST(0 AS DOUBLE) AS x, round(y, 6) + CAST(0 AS DOUBLE) AS y, round(width, 6) AS width, round(height, 6) AS height FROM (" + ORACLE_SQL["image_placement"] + ")"


@query(f"""WITH {_PARTS}, e AS (SELECT *, CAST(greatest(w, h, 1) AS DOUBLE) AS edge FROM pt), f AS (SELECT *, least(least(greatest(3500.0 / edge, 1.0), 3.0), 10000.0 / edge) AS k FROM e)
SELECT p_partkey, CAST(least(greatest(round(w * k), 1), 10000) AS BIGINT) AS width, CAST(least(greatest(round(h * k), 1), 10000) AS BIGINT) AS height FROM f""")
def enlarged_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", geometry.enlarged(F.col("w"), F.col("h")).alias("d")).select("p_partkey", "d.*")


@query(f"""WITH {_PARTS}, n AS (SELECT *, greatest(round(w * 0.5 * 150 / 72.0), 1) AS nw, greatest(round(h * 0.2 * 150 / 72.0), 1) AS nh FROM pt), k AS (SELECT *, greatest(nw / w, nh / h) AS k FROM n)
SELECT p_partkey, CAST(greatest(round(w * k), 1) AS BIGINT) AS target_width, CAST(greatest(round(h * k), 1) AS BIGINT) AS target_height FROM k WHERE k < 1""")
def placement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images larger than their drawings need at 150 dpi, and what they shrink to."""
    rows = _parts(spark, sf_dir).select("p_partkey", F.col("w").alias("pixel_width"), F.col("h").alias("pixel_height"), (F.col("w") * 0.1).alias("width"), (F.col("h") * 0.04).alias("height"))
    return images.placement_plan(rows, 150).select("p_partkey", "target_width", "target_height")


ORACLE_SQL["placement_plan"] = ORACLE_SQL["placement_plan"].replace("w * 0.5 *", "w * 0.1 *").replace("h * 0.2 *", "h * 0.04 *")


@query(f"WITH {_PARTS} SELECT p_partkey, CAST([2.0 * w, 0.0, 0.0, 3.0 * h, w + 10.0, h + 20.0] AS DOUBLE[]) AS m, CAST(abs(2.0 * w) AS DOUBLE) AS width, CAST(abs(3.0 * h) AS DOUBLE) AS height FROM pt")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, z = F.col("w").cast("double"), F.col("h").cast("double"), F.lit(0.0)
    m = geometry.matrix_product(F.array(F.lit(2.0), z, z, F.lit(3.0), F.lit(1.0), F.lit(1.0)), F.array(w, z, z, h, F.lit(10.0), F.lit(20.0)))
    width, height = geometry.drawn_size(F.col("m"))
    return _parts(spark, sf_dir).select("p_partkey", m.alias("m")).select("p_partkey", "m", width.alias("width"), height.alias("height"))


@query(f"WITH {_PARTS} SELECT p_partkey, CASE WHEN abs(841.89 / 595.28 - greatest(w, h) / least(w, h)) <= abs(792.0 / 612.0 - greatest(w, h) / least(w, h)) THEN 'a4' ELSE 'letter' END AS paper FROM pt")
def nearest_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", geometry.nearest_scan_paper(F.least("w", "h"), F.greatest("w", "h")).alias("paper"))


@query("WITH o(orientation, turn, mirrored) AS (VALUES (1, 0, false), (6, 90, false), (3, 180, false), (8, 270, false), (2, 0, true), (7, 90, true), (4, 180, true), (5, 270, true)) SELECT a.orientation, d.degrees, b.orientation AS turned FROM o a, (VALUES (-90), (0), (90), (180), (450)) d(degrees) JOIN o b ON b.mirrored = a.mirrored AND b.turn = (a.turn + d.degrees + 720) % 360")
def exif_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(o, d) for o in range(1, 9) for d in (-90, 0, 90, 180, 450)], "orientation int, degrees int")
    return grid.select("orientation", "degrees", geometry.rotated_orientation(F.col("orientation"), F.col("degrees")).alias("turned"))


_STEPS = "[" + ", ".join(f"CAST(floor(n_chars * {d * q} / 25500.0) AS BIGINT)" for d, q in images.LADDER) + "]"


@query(f"SELECT doc_id, CASE WHEN n_chars <= 700 THEN -1 ELSE CAST(list_position(list_transform({_STEPS}, lambda s: s <= 700), true) AS INT) - 1 END AS step FROM documents")
def size_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gentlest step of reduction that fits a limit; sizes are modelled on the length of texts."""
    sizes = F.array(F.col("n_chars"), *(F.floor(F.col("n_chars") * (d * q) / 25500.0).cast("bigint") for d, q in images.ladder()))
    return _table(spark, sf_dir, "documents").select("doc_id", images.size_step(sizes, F.lit(700)).alias("step"))


_PATHS = "paths AS (SELECT doc_id, '/data/' || source || '/scan ' || (doc_id % 50) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' ELSE '.jpg' END AS path FROM documents)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(F.lit(".PDF"), F.lit(".tar.gz"), F.lit(""), F.lit(".jpg")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/scan "), (F.col("doc_id") % 50).cast("string"), ending).alias("path"))


@query(f"""WITH {_PATHS}, s AS (SELECT doc_id, path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM paths),
t AS (SELECT *, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE name END AS stem, CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.([^.]*)$', 1) ELSE 'pdf' END AS ext FROM s)
SELECT doc_id, dir || stem || '_edited.' || ext AS beside, '/out/' || name AS inside, dir || stem || '_page_1.jpg' AS picture FROM t""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", names.edited_destination(path, "edited").alias("beside"), names.edited_destination(path, "edited", directory="/out").alias("inside"), names.jpeg_name(path, tag=F.lit("page_1")).alias("picture"))


@query(f"WITH {_PATHS} SELECT '/out/' || regexp_extract(path, '([^/]*)$', 1) AS destination, count(*) AS inputs FROM paths GROUP BY 1 HAVING count(*) > 1")
def destination_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations that several inputs would write."""
    rows = _paths(spark, sf_dir).withColumn("destination", names.edited_destination(F.col("path"), "edited", directory="/out"))
    return batches.conflicts(rows, "destination")


@query(f"WITH {_PATHS}, n AS (SELECT doc_id, '/md/' || regexp_extract(path, '([^/.]*)[^/]*$', 1) AS base FROM paths), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS k FROM n) SELECT doc_id, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.md' AS file FROM r")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown names, numbered where they repeat."""
    base = F.concat(F.lit("/md/"), F.regexp_extract("path", "([^/.]*)[^/]*$", 1))
    return batches.numbered_names(_paths(spark, sf_dir).withColumn("base", base), "base", "doc_id", ".md").select("doc_id", "file")


@query(f"WITH {_PATHS} SELECT doc_id, CASE regexp_extract(lower(path), '\\.([a-z0-9]*)$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'jpg' THEN 'jpeg' END AS format, CASE regexp_extract(lower(path), '\\.([a-z0-9]*)$', 1) WHEN 'pdf' THEN false WHEN 'jpg' THEN true END AS is_image FROM paths")
def format_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.with_format(_paths(spark, sf_dir)).select("doc_id", "format", "is_image")


@query("SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'new' END IS NULL AS kept, CASE WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 3 = 0 THEN lang ELSE 'new' END AS title, source AS author FROM documents")
def info_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties patched: null leaves a value, an empty one removes it."""
    new = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 1, "").otherwise("new")
    old = F.create_map(F.lit("Title"), F.col("lang"), F.lit("Author"), F.col("source"))
    patched = batches.patched(old, F.create_map(F.lit("Title"), F.col("new")))
    return _table(spark, sf_dir, "documents").withColumn("new", new).withColumn("m", patched).select("doc_id", "source", F.col("new").isNull().alias("kept"), F.try_element_at("m", F.lit("Title")).alias("title"), F.try_element_at("m", F.lit("Author")).alias("author"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 0) AS succeeded, count(*) FILTER (WHERE toxic <> 0) AS failed, CAST(sum(CASE WHEN toxic = 0 THEN quality + 1 ELSE 0 END) AS BIGINT) AS outputs, CASE WHEN count(*) FILTER (WHERE toxic <> 0) = 0 THEN 0 WHEN count(*) FILTER (WHERE toxic = 0) = 0 THEN 1 ELSE 2 END AS exit_code FROM labels")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of a batch; a label of toxicity stands for a failure."""
    results = _table(spark, sf_dir, "labels").select(F.when(F.col("toxic") != 0, "failed").alias("error"), (F.col("quality") + 1).alias("outputs"))
    return batches.summary(results)


@query("""SELECT doc_id, '{"level":"info","event":"written","message":"document ' || doc_id || '","data":{"chars":' || n_chars || '}}' AS line FROM documents""")
def ndjson_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", batches.event(F.lit("info"), F.lit("written"), F.concat(F.lit("document "), F.col("doc_id").cast("string")), F.struct(F.col("n_chars").alias("chars"))).alias("line"))


@query(f"WITH {LINES}, o AS (SELECT doc, CAST(page // 4 AS BIGINT) AS parent, page AS item FROM lines) SELECT doc, parent, item, lag(item) OVER w AS previous, lead(item) OVER w AS next FROM o WINDOW w AS (PARTITION BY doc, parent ORDER BY item)")
def outline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.outline_links(_lines(spark, sf_dir).select("doc", F.floor(F.col("page") / 4).alias("parent"), F.col("page").alias("item")))


@query(f"WITH {LINES}, new AS (SELECT doc, page, CASE WHEN page % 4 = 0 THEN '  ' ELSE 'read ' || page END AS t FROM lines WHERE page % 2 = 0) SELECT l.doc, l.page, md5(coalesce(nullif(trim(t), ''), l.text)) AS text FROM lines l LEFT JOIN new USING (doc, page)")
def recognised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text in place of a page's own, unless it is empty."""
    rows = _lines(spark, sf_dir)
    new = rows.where("page % 2 = 0").select("doc", "page", F.when(F.col("page") % 4 == 0, "  ").otherwise(F.concat(F.lit("read "), F.col("page").cast("string"))).alias("recognised"))
    return batches.with_recognised(rows, new).select("doc", "page", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"WITH {LINES}, m AS (SELECT doc, page % 5 AS id, max(page) AS href FROM lines GROUP BY 1, 2), s AS (SELECT doc, page AS pos, (page * 3) % 7 AS idref FROM lines) SELECT doc, pos, href FROM s JOIN m ON s.doc = m.doc AND idref = id".replace("SELECT doc, pos, href FROM s", "SELECT s.doc, pos, href FROM s"))
def spine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in reading order: manifest entries by id, the later of equal ids; unknown ids are left out."""
    rows = _lines(spark, sf_dir)
    manifest = rows.select("doc", (F.col("page") % 5).alias("id"), F.col("page").alias("pos"), F.col("page").alias("href"))
    spine = rows.select("doc", F.col("page").alias("pos"), (F.col("page") * 3 % 7).alias("id"))
    return batches.reading_order(spine, manifest)


@query(f"WITH {LINES} SELECT doc, page, CAST(sum(length(text)) OVER (PARTITION BY doc ORDER BY page) AS BIGINT) AS used, sum(length(text)) OVER (PARTITION BY doc ORDER BY page) > 2000 AS over_budget FROM lines")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running size of an archive's entries against a limit."""
    return batches.running_budget(_lines(spark, sf_dir).withColumn("size", F.length("text")), 2000).select("doc", "page", "used", "over_budget")


def _values(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")


def _sql_values(rows: list[tuple], columns: str) -> str:
    show = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


#: Expected results of the parsers.
_SIZES = [("A4", "paper", 595, 842), ("297x210mm", "paper", 595, 842), ("21 x 29,7 cm", "paper", 595, 842), ("letter", "paper", 612, 792), ("8.5x11in", "paper", 612, 792), ("612x792pt", "paper", 612, 792), ("Legal", "paper", 612, 1008), ("a3", "paper", 842, 1191), ("keep", "keep", None, None), ("ORIGINAL", "keep", None, None), ("fit", "fit", None, None), ("A9", None, None, None), ("x", None, None, None), ("0x10", None, None, None), ("10x10km", None, None, None), ("100000x10", None, None, None)]


@query("SELECT value, kind, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM (" + _sql_values(_SIZES, "value, kind, width, height") + ")")
def page_size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [r[0] for r in _SIZES]).select("value", parsers.page_size(F.col("value")).alias("s")).select("value", "s.kind", F.round("s.width").cast("bigint").alias("width"), F.round("s.height").cast("bigint").alias("height"))


_BYTES = [("10MB", 10485760), ("1.5 m", 1572864), ("500кб", 512000), ("2048", 2048), ("ten MB", None), ("5 TB", None), ("0", None)]


@query("SELECT value, CAST(bytes AS BIGINT) AS bytes FROM (" + _sql_values(_BYTES, "value, bytes") + ")")
def byte_size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [r[0] for r in _BYTES]).select("value", parsers.byte_size(F.col("value")).alias("bytes"))


_COLOURS = [("black", "0,0,0"), ("#FF0000", "255,0,0"), ("00ff00", "0,255,0"), (" Green ", "0,140,0"), ("#12345", None), ("purple", None)]


@query(_sql_values(_COLOURS, "value, rgb"))
def colour_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.array_join(F.transform(parsers.colour(F.col("value")), lambda c: F.round(c * 255).cast("int").cast("string")), ",")
    return _values(spark, [r[0] for r in _COLOURS]).select("value", rgb.alias("rgb"))


_POSITIONS = [("tl", "tl", 0.0, 0.0), ("Top-Left", "tl", 0.0, 0.0), ("", "br", 0.0, 0.0), ("-5, 2.5", "br", -5.0, 2.5), ("center", "c", 0.0, 0.0), ("5,x", None, None, None), ("middle", None, None, None)]


@query("SELECT value, anchor, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (" + _sql_values(_POSITIONS, "value, anchor, x, y") + ")")
def position_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [r[0] for r in _POSITIONS]).select("value", parsers.position(F.col("value")).alias("p")).select("value", "p.*")


_RETRIES = [("1.5", "", 1, 1500), (None, "try again in 2.25s.", 1, 2250), ("999", "", 1, 120000), (None, "Please try again in 1m2.5s.", 1, 62500), (None, "busy", 3, 15000)]


@query("SELECT header, body, attempt, CAST(ms AS BIGINT) AS ms FROM (" + _sql_values(_RETRIES, "header, body, attempt, ms") + ")")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in _RETRIES], "header string, body string, attempt int")
    return rows.select("header", "body", "attempt", parsers.retry_milliseconds(F.col("header"), F.col("body"), F.col("attempt")).alias("ms"))


_OPTIONS = [("1200x1600", 1200, None, None), (" 90 ", None, 90, None), ("-270", None, -270, None), ("45", None, None, None), ("WIN", None, None, "windows"), ("groq", None, None, "groq"), ("0x5", None, None, None), ("16385x1", None, None, None)]


@query("SELECT value, CAST(width AS INT) AS width, CAST(degrees AS BIGINT) AS degrees, engine FROM (" + _sql_values(_OPTIONS, "value, width, degrees, engine") + ")")
def option_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _values(spark, [r[0] for r in _OPTIONS]).select("value", parsers.viewport(v)["width"].alias("width"), parsers.rotation(v)["degrees"].alias("degrees"), parsers.engine(v).alias("engine"))


_LISTS = [("3,1-2,3", 4, "3,1,2,3"), ("3-", 4, "3,4"), ("-2,last-3", 4, "1,2,4,3"), ("reverse", 3, "3,2,1"), ("first,even", 5, "1,2,4"), ("0", 5, None), ("6", 5, None), (" , ", 3, None), ("even", 1, None)]


@query(_sql_values(_LISTS, "value, n, pages"))
def page_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in _LISTS], "value string, n int")
    return rows.select("value", "n", F.array_join(F.transform(parsers.page_list(F.col("value"), F.col("n")), lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', n_chars / 1024.0) ELSE format('{:.2f} MB', n_chars / 1048576.0) END AS size FROM documents")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", parsers.human_size(F.col("n_chars")).alias("size"))


@query()
def pdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as PDF files and read back: pages, and characters but white space, of each."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pdf_files.pages(pdf_files.from_texts(docs, "doc_id", "text"))
    counted = rows.groupBy("path").agg(F.count("*").alias("pages"), F.sum(text.visible_characters(F.col("text"))).alias("visible"), F.max("error").alias("error"))
    return counted.select(F.col("path").cast("bigint").alias("doc_id"), "pages", "visible", "error")


ORACLE_SQL["pdf_visible_text"] = "SELECT doc_id, CAST(length(regexp_replace(text, '[\\s\\pZ]', '', 'g')) AS BIGINT) AS visible FROM documents"
QUERIES["pdf_visible_text"] = lambda spark, sf_dir: pdf_round_trip(spark, sf_dir).select("doc_id", F.col("visible").cast("bigint").alias("visible"))


_MISREAD = "CASE doc_id % 3 WHEN 0 THEN translate(text, 'oe', 'ое') WHEN 1 THEN translate(text, 'ol', '01') ELSE translate(text, '01368', 'Оl3зб8') END"
_LIKE = "".join(recognition.DIGIT_LOOKALIKES)
_NUMERALS = "".join(recognition.DIGIT_LOOKALIKES.values())


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all('NQ' || doc_id || ' N9' || (1000 + doc_id) || ' ' || {_MISREAD}, '[\t-\r\x{{85}}\pZ]+|[^\t-\r\x{{85}}\pZ]+') AS ts FROM documents),
tokens AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM t),
signed AS (SELECT doc_id, i, CASE WHEN regexp_matches(t, '^N[Qg°º]([0-9]|$)') THEN '№' || substr(t, 3) WHEN regexp_matches(t, '^N9[0-9]{{3}}') THEN '№' || substr(t, 3) ELSE t END AS t FROM tokens),
kinds AS (SELECT DISTINCT t FROM signed),
runs AS (SELECT t, unnest(p) AS r, generate_subscripts(p, 1) AS k FROM (SELECT t, regexp_extract_all(t, '[0-9{_LIKE}.,/:-]+|[^0-9{_LIKE}.,/:-]+') AS p FROM kinds)),
cores AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after, regexp_extract(r, '^[.,/:-]*', 0) AS head, regexp_extract(r, '[.,/:-]*$', 0) AS tail, regexp_replace(regexp_replace(r, '^[.,/:-]+', ''), '[.,/:-]+$', '') AS core FROM runs WINDOW w AS (PARTITION BY t ORDER BY k)),
judged AS (SELECT *, length(regexp_replace(core, '[^0-9]', '', 'g')) AS n, length(regexp_replace(core, '[^{_LIKE}]', '', 'g')) AS l,
  (head = '' AND coalesce(regexp_matches(before, '\pL$'), false)) OR (tail = '' AND coalesce(regexp_matches(after, '^\pL'), false)) AS touched FROM cores),
numbers AS (SELECT t, string_agg(CASE WHEN regexp_matches(r, '^[0-9{_LIKE}.,/:-]') AND l > 0 AND n >= greatest(2, l) AND NOT touched THEN head || translate(core, '{_LIKE}', '{_NUMERALS}') || tail ELSE r END, '' ORDER BY k) AS d FROM judged GROUP BY t),
counted AS (SELECT t, d, length(regexp_replace(d, '[^Ѐ-ӿ]', '', 'g')) AS c, length(regexp_replace(d, '[^A-Za-z]', '', 'g')) AS l FROM numbers),
turned AS (SELECT t, d, c > l AS russian, greatest(c, l) >= 3 AND NOT regexp_matches(d, '[2-9]') AS word,
  CASE WHEN c = 0 OR l = 0 OR c = l THEN d WHEN c > l THEN translate(d, '{recognition.LATIN}', '{recognition.CYRILLIC}') ELSE translate(d, '{recognition.CYRILLIC}', '{recognition.LATIN}') END AS s FROM counted),
zeros AS (SELECT t, russian, word, unnest(p) AS r, generate_subscripts(p, 1) AS k FROM (SELECT *, regexp_extract_all(s, '[01]+|[^01]+') AS p FROM turned)),
beside AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM zeros WINDOW w AS (PARTITION BY t ORDER BY k)),
spelt AS (SELECT t, string_agg(CASE WHEN NOT word OR NOT regexp_matches(r, '^[01]') OR before IS NULL OR after IS NULL OR NOT regexp_matches(before, '\pL$') OR NOT regexp_matches(after, '^\pL') OR (russian AND contains(r, '1')) THEN r
    ELSE translate(r, '01', CASE WHEN regexp_matches(before, '\p{{Lu}}$') AND regexp_matches(after, '^\p{{Lu}}') THEN CASE WHEN russian THEN 'ОI' ELSE 'OI' END ELSE CASE WHEN russian THEN 'оl' ELSE 'ol' END END) END, '' ORDER BY k) AS out FROM beside GROUP BY t)
SELECT doc_id, md5(string_agg(out, '' ORDER BY i)) AS corrected FROM signed s JOIN spelt p ON p.t = s.t GROUP BY doc_id""")
def ocr_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of texts in which letters and digits are misread for each other, by a rule for each third of them."""
    n, own = F.col("doc_id"), F.col("text")
    misread = F.when(n % 3 == 0, F.translate(own, "oe", "ое")).when(n % 3 == 1, F.translate(own, "ol", "01")).otherwise(F.translate(own, "01368", "Оl3зб8"))
    made = F.concat(F.lit("NQ"), n.cast("string"), F.lit(" N9"), (n + 1000).cast("string"), F.lit(" "), misread)
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(recognition.corrected(made).cast("binary")).alias("corrected"))


@query()
def decode_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files in several encodings."""
    rows = [("utf-8.txt", bytearray("Привет".encode())), ("old.txt", bytearray("Привет".encode("cp1251"))), ("mark.txt", bytearray(b"\xef\xbb\xbfA")), ("koi8.txt", bytearray("<?xml version='1.0' encoding='koi8-r'?>Да".encode("koi8-r")))]
    return documents.read_texts(spark.createDataFrame(rows, "path string, content binary"))


ORACLE_SQL["decode_legacy"] = _sql_values([("utf-8.txt", "text", "Привет", None), ("old.txt", "text", "Привет", None), ("mark.txt", "text", "A", None), ("koi8.txt", "text", "<?xml version='1.0' encoding='koi8-r'?>Да", None)], "path, format, text, error").replace("SELECT *", "SELECT path, format, text, CAST(error AS VARCHAR) AS error")


@query(f"WITH {LINES}, w AS (SELECT doc, CAST(page // 3 AS BIGINT) AS line, CAST(page * 7 % 50 AS DOUBLE) AS x, CAST(page % 5 AS DOUBLE) AS y, CAST(10 + page % 4 AS DOUBLE) AS height FROM lines) SELECT doc, line, min(x) AS x, min(y) AS y, max(y + height) AS bottom FROM w GROUP BY doc, line")
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page")
    words = _lines(spark, sf_dir).select("doc", F.floor(page / 3).alias("line"), (page * 7 % 50).cast("double").alias("x"), (page % 5).cast("double").alias("y"), (10 + page % 4).cast("double").alias("height"))
    return batches.line_boxes(words)


@query(f"""WITH {LINES}, p AS (SELECT doc % 20 AS input, doc, page, length(text) < 60 AS blank FROM lines),
d AS (SELECT input, doc, bool_and(blank) AS empty FROM p GROUP BY input, doc), k AS (SELECT *, bool_and(empty) OVER (PARTITION BY input) AS every FROM d)
SELECT p.input, p.doc, page, blank FROM p JOIN k ON p.input = k.input AND p.doc = k.doc WHERE NOT empty OR every""")
def blank_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of short lines alone are left out of a merge, unless all are such."""
    rows = _lines(spark, sf_dir).select((F.col("doc") % 20).alias("input"), "doc", "page", (F.length("text") < 60).alias("blank"))
    return batches.without_blank_inputs(rows)


@query(f"WITH {LINES}, n AS (SELECT DISTINCT doc, 'p' || (page % 4) AS name, 'p' || (page % 4) || '_2' AS new FROM lines WHERE page % 2 = 1) SELECT l.doc, l.page, 'p' || (l.page % 4) AS name, coalesce(n.new, 'p' || (l.page % 4)) AS target FROM lines l LEFT JOIN n ON n.doc = l.doc AND n.name = 'p' || (l.page % 4)")
def rename_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links under the names their targets got in a merge."""
    links = _lines(spark, sf_dir).select("doc", "page", F.concat(F.lit("p"), (F.col("page") % 4).cast("string")).alias("name"))
    new = links.where("page % 2 = 1").select("doc", "name", F.concat("name", F.lit("_2")).alias("new")).distinct()
    return batches.renamed(links, new).select("doc", "page", "name", "target")


@query("WITH f AS (SELECT '/cache/' || CASE doc_id % 3 WHEN 0 THEN sha256(text) || '.md' WHEN 1 THEN sha256(text) || '.json' ELSE 'note' || doc_id || '.md' END AS path, n_chars AS length FROM documents) SELECT count(*) AS files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM f WHERE regexp_matches(path, '/[0-9a-f]{64}\\.(md|json)$')")
def cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and bytes that emptying a cache removes."""
    key = text.content_key(F.col("text"))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(key, F.lit(".md"))).when(F.col("doc_id") % 3 == 1, F.concat(key, F.lit(".json"))).otherwise(F.concat(F.lit("note"), F.col("doc_id").cast("string"), F.lit(".md")))
    return batches.cache_entries(_table(spark, sf_dir, "documents").select(F.concat(F.lit("/cache/"), name).alias("path"), F.col("n_chars").alias("length")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'mask' WHEN p_partkey % 11 = 0 THEN 'stencil' WHEN p_partkey % 13 = 0 THEN 'decode' WHEN p_size % 3 = 0 THEN 'bits' END AS reason, p_partkey % 5 = 0 OR p_size * 20 < p_retailprice AS taken FROM part")
def unsafe_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that are not resampled, with the reason, and replacements that are taken."""
    k = F.col("p_partkey")
    reason = images.unsafe_reason(k % 7 == 0, k % 11 == 0, k % 13 == 0, F.when(F.col("p_size") % 3 == 0, 4).when(k % 2 == 0, 8))
    return _table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"), images.kept_smaller(F.col("p_retailprice"), F.col("p_size") * 20, k % 5 == 0).alias("taken"))


@query("WITH r AS (SELECT p_partkey, [CAST(p_size AS DOUBLE), CAST(-(p_partkey % 9) AS DOUBLE), CAST(-p_size AS DOUBLE), CAST(p_partkey % 9 AS DOUBLE)] AS rises FROM part) SELECT p_partkey, CAST(4 - list_position(list_reverse(rises), list_max(rises)) AS INT) AS turns FROM r")
def upright_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter turns that set an image upright; the last of equals."""
    size, other = F.col("p_size").cast("double"), (F.col("p_partkey") % 9).cast("double")
    return _table(spark, sf_dir, "part").select("p_partkey", images.upright_turns(F.array(size, -other, -size, other)).cast("int").alias("turns"))


_A, _B = 210.0 * 72.0 / 25.4, 297.0 * 72.0 / 25.4


@query(f"""WITH {_SHEETS}, {_SHOWN}, t AS (SELECT *, (w > h) <> (rot % 180 = 90) AS lying FROM shown),
s AS (SELECT *, CASE WHEN lying THEN {_B!r} ELSE {_A!r} END AS tw, CASE WHEN lying THEN {_A!r} ELSE {_B!r} END AS th FROM t), k AS (SELECT *, least(tw / (r - l), th / (t - b)) AS k FROM s)
SELECT doc, page, round(k, 8) AS scale, round((tw - (r - l) * k) / 2, 6) + CAST(0 AS DOUBLE) AS x, round((th - (t - b) * k) / 2, 6) + CAST(0 AS DOUBLE) AS y, round(5 * k + (tw - (r - l) * k) / 2, 6) AS px FROM k""")
def page_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and shift that fit pages onto A4, and a point moved along."""
    rows, _ = _sheets(spark, sf_dir)
    made = rows.withColumn("m", geometry.page_resize(*(F.col(c) for c in ("l", "b", "r", "t", "rot"))))
    px = geometry.moved_points(F.array(F.lit(5.0), F.lit(7.0)), F.col("m.scale"), F.col("m.x"), F.col("m.y"))[0]
    return made.select("doc", "page", F.round("m.scale", 8).alias("scale"), (F.round("m.x", 6) + 0.0).alias("x"), (F.round("m.y", 6) + 0.0).alias("y"), F.round(px, 6).alias("px"))


@query("""WITH g AS (SELECT p_partkey, ['tl','tc','tr','l','c','r','bl','bc','br'][CAST(p_partkey % 9 + 1 AS INT)] AS anchor, 500.0 + p_size AS w, 700.0 AS h, 72.0 / 25.4 AS mm FROM part)
SELECT p_partkey, anchor, round(CASE WHEN anchor IN ('tl', 'l', 'bl') THEN 10 * mm WHEN anchor IN ('tc', 'c', 'bc') THEN (w - 50) / 2 ELSE w - 10 * mm - 50 END + 2 * mm, 6) AS x,
round(CASE WHEN anchor IN ('tl', 'tc', 'tr') THEN h - 10 * mm - 30 WHEN anchor IN ('l', 'c', 'r') THEN (h - 30) / 2 ELSE 10 * mm END - 1 * mm, 6) AS y FROM g""")
def stamp_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of stamps on pages by anchor and offset."""
    anchor = F.element_at(F.array(*map(F.lit, ("tl", "tc", "tr", "l", "c", "r", "bl", "bc", "br"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    zero, f = F.lit(0.0), F.lit
    rows = _table(spark, sf_dir, "part").select("p_partkey", anchor.alias("anchor"), (500.0 + F.col("p_size")).alias("w"))
    p = geometry.stamp_position(F.col("anchor"), f(2.0), f(-1.0), zero, zero, F.col("w"), f(700.0), f(50.0), f(30.0))
    return rows.select("p_partkey", "anchor", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


_NAMED = [(210.0, 297.0, "A4"), (215.9, 355.6, "Legal"), (279.4, 431.8, "Tabloid"), (100.0, 200.0, "100x200 mm"), (210.1, 297.1, "A4")]


@query(_sql_values([(n,) for _, _, n in _NAMED], "name"))
def paper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in _NAMED], "w double, h double")
    scale = parsers.POINTS_PER_MM
    return rows.select(geometry.paper_name(F.col("w") * scale, F.col("h") * scale).alias("name"))


@query("SELECT page_id, md5(CASE WHEN contains(html, '<head>') THEN substr(html, 1, strpos(html, '<head>') + 5) || '<base href=\"file:///a%20b/\">' || substr(html, strpos(html, '<head>') + 6) END || '<script></script>') AS page FROM pages")
def head_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a base address put into their heads."""
    made = names.with_base(F.col("html"), names.file_url(F.lit("/a b/")), "<script></script>")
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(made.cast("binary")).alias("page"))





@query(f"WITH d AS (SELECT doc_id % 100 AS doc, doc_id AS page, text FROM documents), n AS (SELECT doc, page, CASE WHEN length(regexp_replace(text, '[\\s\\pZ]', '', 'g')) >= 100 THEN text ELSE 'read ' || length(text) END AS t FROM d) SELECT doc, md5(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS text FROM n GROUP BY doc")
def recognition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents whose pages without a text layer are recognised, each content once."""
    rows = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("doc"), F.col("doc_id").alias("page"), "text")
    wanted = recognition_plans.needed(rows).select("doc", "page", F.col("text").cast("binary").alias("image"))
    cache = spark.createDataFrame([], "key string, payload string")
    found, _ = recognition_plans.recognised(wanted, cache, recognition_plans.each(lambda raw: f"read {len(raw.decode())}"))
    return recognition_plans.texts(rows, found).select("doc", F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT doc_id, CAST(1 AS INT) AS page, CAST(64 AS INT) AS width, CAST(greatest(1, (strlen(text) + 63) // 64) AS INT) AS height, md5(text) AS bytes FROM documents")
def png_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pixels of PNG files, written and read back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    read = raster_files.pixel_bytes(raster_files.pictures_of(docs, "doc_id", "text"))
    return read.select(F.col("path").cast("bigint").alias("doc_id"), "page", "width", "height", F.md5(F.expr("rtrim(decode(unhex('00'), 'UTF-8'), decode(data, 'UTF-8'))").cast("binary")).alias("bytes"))


@query("""WITH d AS (SELECT doc_id, greatest(1, (strlen(text) + 63) // 64) AS rows FROM documents)
SELECT doc_id, CAST(1 AS INT) AS page, round(64 * 0.75, 6) + CAST(0 AS DOUBLE) AS width, round(rows * 0.75, 6) + CAST(0 AS DOUBLE) AS height, CAST(1 AS INT) AS images, CAST(NULL AS VARCHAR) AS error FROM d""")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files as JPEGs on pages of PDF files at 96 dots an inch, read back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = raster_files.image_documents(raster_files.pictures_of(docs, "doc_id", "text"), sheet=None)
    read = pdf_files.pages(made, failed="error")
    return read.select(F.col("path").cast("bigint").alias("doc_id"), "page", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"), "images", "error")


@query(f"""WITH {_SHEETS}, b AS (SELECT *, 10.0 AS x, 20.0 AS y, 30.0 AS w, 5.0 AS h FROM sheets),
m AS (SELECT doc, page, CASE rot WHEN 90 THEN [0.0, 30, -5, 0, (r - l) - 20, 10] WHEN 180 THEN [-30.0, 0, 0, -5, (r - l) - 10, (t - b) - 20] WHEN 270 THEN [0.0, -30, 5, 0, 20, (t - b) - 10] ELSE [30.0, 0, 0, 5, 10, 20] END AS m FROM b)
SELECT doc, page, list_transform(m, lambda v: round(CAST(v AS DOUBLE), 6) + 0.0) AS m FROM m""")
def upright_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of stamps that stay upright on turned pages."""
    rows, _ = _sheets(spark, sf_dir)
    m = geometry.upright_stamp(*map(F.lit, (10.0, 20.0, 30.0, 5.0)), *(F.col(c) for c in ("l", "b", "r", "t", "rot")))
    return rows.select("doc", "page", F.transform(m, lambda v: F.round(v, 6) + 0.0).alias("m"))


@query("""WITH g AS (SELECT p_partkey, CAST(length(p_name) * 0.5 AS DOUBLE) * (p_partkey % 10 > 0)::INT AS unit, CAST(p_partkey % 4 * 45 AS DOUBLE) AS angle, 300.0 + p_size AS w, CAST(400 AS DOUBLE) AS h FROM part)
SELECT p_partkey, round(CASE WHEN unit = 0 THEN 12.0 ELSE least((CASE WHEN angle = 0 THEN w * 0.8 ELSE sqrt(w * w + h * h) * 0.6 END) / unit, h / 5) END, 6) AS size FROM g""")
def mark_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of text marks that are to fill a page."""
    key = F.col("p_partkey")
    unit = F.length("p_name") * 0.5 * (key % 10 > 0).cast("int")
    size = geometry.mark_size(unit, (key % 4 * 45).cast("double"), 300.0 + F.col("p_size"), F.lit(400.0))
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(size, 6).alias("size"))


@query("""WITH RECURSIVE i AS (SELECT o_custkey AS batch, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'd/' || o_custkey || '_merged.pdf' ELSE 'd/' || o_custkey || '.' || (CASE WHEN o_orderkey % 3 = 0 THEN 'pdf' ELSE 'png' END) END AS path FROM orders),
e AS (SELECT DISTINCT 'd/' || c_custkey || (CASE c_custkey % 4 WHEN 0 THEN '_merged_2' WHEN 1 THEN '_merged' WHEN 2 THEN '' ELSE '_merged_02' END) || '.pdf' AS path FROM customer),
f AS (SELECT batch, count(*) AS n, regexp_replace(arg_min(path, seq), '[.][a-z]+$', '') AS stem FROM i GROUP BY batch),
c AS (SELECT batch, stem, 0 AS k, CASE WHEN n = 1 THEN stem || '.pdf' ELSE stem || '_merged.pdf' END AS file FROM f
UNION ALL SELECT c.batch, stem, k + 1, CASE WHEN file = stem || '.pdf' THEN stem || '_merged.pdf' WHEN file = stem || '_merged.pdf' THEN stem || '_merged_2.pdf' ELSE stem || '_merged_' || (CAST(regexp_extract(file, '_merged_([0-9]+)[.]pdf$', 1) AS INT) + 1) || '.pdf' END
FROM c WHERE EXISTS (FROM e WHERE e.path = file) OR EXISTS (FROM i WHERE i.batch = c.batch AND i.path = file))
SELECT batch, arg_max(file, k) AS file FROM c GROUP BY batch""")
def merged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the merged files of batches, beside inputs and files that are there already."""
    key, batch = F.col("o_orderkey"), F.col("o_custkey")
    stem = F.concat(F.lit("d/"), batch.cast("string"))
    path = F.when(key % 5 == 0, F.concat(stem, F.lit("_merged.pdf"))).otherwise(F.concat(stem, F.when(key % 3 == 0, ".pdf").otherwise(".png")))
    inputs = _table(spark, sf_dir, "orders").select(batch.alias("batch"), key.alias("seq"), path.alias("path"))
    k = F.col("c_custkey")
    ending = F.when(k % 4 == 0, "_merged_2").when(k % 4 == 1, "_merged").when(k % 4 == 2, "").otherwise("_merged_02")
    existing = _table(spark, sf_dir, "customer").select(F.concat(F.lit("d/"), k.cast("string"), ending, F.lit(".pdf")).alias("path"))
    return batches.merged_outputs(inputs, existing)


@query("""WITH f AS (SELECT p_partkey, 'f' || p_partkey || (CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.docx' END) AS path, CASE WHEN p_partkey % 2 = 0 THEN '1-' || p_size END AS pages FROM part)
SELECT p_partkey, CASE WHEN pages IS NOT NULL AND NOT ends_with(path, '.pdf') THEN 'page ranges are only valid for PDF inputs: ' || path END AS error FROM f""")
def checked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges given to files that have no pages."""
    key = F.col("p_partkey")
    path = F.concat(F.lit("f"), key.cast("string"), F.when(key % 3 == 0, ".pdf").when(key % 3 == 1, ".png").otherwise(".docx"))
    files = _table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.when(key % 2 == 0, F.concat(F.lit("1-"), F.col("p_size").cast("string"))).alias("pages"))
    return batches.checked_ranges(names.with_format(files)).select("p_partkey", "error")


@query(f"""WITH {LINES}, w AS (SELECT doc, page AS pos, text, CAST(page // 2 % 3 AS DOUBLE) AS line_y FROM lines WHERE regexp_matches(text, '[^\\s\\pZ]')),
g AS (SELECT *, lag(line_y) OVER (PARTITION BY doc ORDER BY pos) AS old FROM w)
SELECT doc, pos, CAST(sum(CASE WHEN old = line_y THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS object FROM g""")
def text_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text objects of words laid over a page, one for each line."""
    words = _lines(spark, sf_dir).select("doc", F.col("page").alias("pos"), "text", (F.floor(F.col("page") / 2) % 3).cast("double").alias("line_y"))
    return pages.text_objects(words).select("doc", "pos", F.col("object").cast("bigint").alias("object"))


@query(f"""WITH {LINES}, w AS (SELECT doc, page AS pos, CAST(page * 7 % 5 AS DOUBLE) AS x, CAST(page % 3 AS DOUBLE) AS y, CAST(4 + page % 2 * 2 AS DOUBLE) AS height FROM lines)
SELECT doc, pos, CAST(row_number() OVER (PARTITION BY doc ORDER BY y + height / 2, x, pos) AS INT) AS place FROM w""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the order in which they are read."""
    page = F.col("page")
    words = _lines(spark, sf_dir).select("doc", page.alias("pos"), (page * 7 % 5).cast("double").alias("x"), (page % 3).cast("double").alias("y"), (4 + page % 2 * 2).cast("double").alias("height"))
    return pages.reading_order(words).select("doc", "pos", "place")


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_linenumber + CAST(l_partkey % 3 AS INT) AS wanted FROM lineitem)
SELECT doc, page, wanted, CASE WHEN NOT EXISTS (FROM p o WHERE o.doc = p.doc AND o.page = p.wanted) THEN 'stamp page ' || wanted || ' does not exist' END AS error FROM p""")
def placed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps on pages, some of which are not there."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") + (F.col("l_partkey") % 3).cast("int")).alias("wanted"))
    placements = rows.select("doc", F.col("wanted").alias("page"), F.col("page").alias("own"))
    made = pages.placed_stamps(placements, rows)
    return made.select("doc", F.col("own").alias("page"), F.col("page").alias("wanted"), "error")


@query("""WITH i AS (SELECT l_orderkey AS doc, l_suppkey % 2 AS page, l_linenumber AS image, CAST(l_quantity AS DOUBLE) AS area, l_linenumber AS pos FROM lineitem WHERE l_partkey % 4 > 0)
SELECT doc, page, arg_max(image, area * 1000 + pos) AS image, max(area) AS area FROM i GROUP BY doc, page""")
def largest_decodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest image of each page among those that could be decoded."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 2).alias("page"), F.col("l_linenumber").alias("image"), F.col("l_quantity").cast("double").alias("area"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_partkey") % 4 == 0, "broken").alias("error"))
    return images.largest_decodable(rows)
