"""Operators on pages: rows ``(doc, page, ...)`` with 1-based page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import parsers, text


def lines_as_pages(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """Each line of a text as a page of its document."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(body, "\n")).alias("pos", "text")).select("doc", (F.col("pos") + 1).alias("page"), "text")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.count("*").cast("int").alias("pages"))


def select_pages(pages: DataFrame, expression: Column | str) -> DataFrame:
    """Pages in the order of a page list, repeats kept, with their place ``pos``; a document it does not fit yields none.

    One shuffle by document serves the count, the list and the lookup: the pages of a
    document travel as one array and are picked from it by position.
    """
    expression = F.lit(expression) if isinstance(expression, str) else expression
    held = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ["page", *(c for c in pages.columns if c not in ("doc", "page"))]]))).alias("held"))
    listed = held.select("doc", "held", F.posexplode(parsers.page_list(expression, F.size("held"))).alias("pos", "number"))
    return listed.select("doc", (F.col("pos") + 1).alias("pos"), F.expr("held[number - 1]").alias("p")).select("doc", "pos", "p.*")


def keep_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return pages.join(chosen, ["doc", "page"], "left_semi")


def drop_pages(pages: DataFrame, dropped: DataFrame) -> DataFrame:
    return pages.join(dropped, ["doc", "page"], "left_anti")


def remove_blank(pages: DataFrame, blank: Column) -> DataFrame:
    """Without blank pages; a document of blank pages alone keeps all of them."""
    whole = Window.partitionBy("doc")
    marked = pages.withColumn("__blank", F.coalesce(blank, F.lit(False)))
    return marked.withColumn("__all", F.min("__blank").over(whole)).where(~F.col("__blank") | F.col("__all")).drop("__blank", "__all")


def number_pages(pages: DataFrame, template: str, start: int = 1) -> DataFrame:
    """Labels of the pages in order, ``{n}`` and ``{total}`` filled in."""
    order = Window.partitionBy("doc").orderBy("page")
    n = F.row_number().over(order) + start - 1
    total = F.count("*").over(Window.partitionBy("doc")) + start - 1
    return pages.withColumn("label", text.page_label(F.lit(template), n, total))


def split_names(pages: DataFrame, name: str = "doc") -> DataFrame:
    """File name of each page when a document is split, padded to the width of the page count."""
    total = F.count("*").over(Window.partitionBy("doc"))
    width = F.length(total.cast("string"))
    return pages.withColumn("file", F.concat(F.col(name).cast("string"), F.lit("_"), F.lpad(F.col("page").cast("string"), width, F.lit("0")), F.lit(".pdf")))


def paginate(lines: DataFrame, *, sheet_height: float = 297.0 * 72 / 25.4, margin: float = 40.0, font: float = 10.0) -> DataFrame:
    """Sheet and line on it of each text line ``(doc, page)``."""
    per_sheet = max(1, int((sheet_height - 2 * margin) / (1.25 * font)))
    at = F.col("page") - 1
    return lines.withColumn("sheet", (F.floor(at / per_sheet) + 1).cast("int")).withColumn("row", (at % per_sheet + 1).cast("int"))


def majority_landscape(pages: DataFrame, landscape: Column) -> DataFrame:
    """``(doc, landscape)``: what most pages are; of equals, what the first page is."""
    votes = pages.withColumn("__l", landscape).groupBy("doc").agg(F.sum(F.when(F.col("__l"), 1).otherwise(-1)).alias("v"), F.min_by("__l", "page").alias("first"))
    return votes.select("doc", F.when(F.col("v") == 0, F.col("first")).otherwise(F.col("v") > 0).alias("landscape"))


def merge_text(parts: DataFrame, group: str, order: str, body: str, joiner: str = text.JOINER) -> DataFrame:
    """The texts of a group joined in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("t")))), lambda x: x["t"])
    return parts.groupBy(group).agg(F.array_join(ordered, joiner).alias("merged"), F.count("*").alias("parts"))


def layout_rows(lines: DataFrame, same_row: float = 0.35) -> DataFrame:
    """Text of a page from recognised lines ``(doc, pos, text, x, y, height)``: rows by height, cells by tab."""
    centre = F.col("y") + F.col("height") / 2
    order = Window.partitionBy("doc").orderBy("centre", "pos")
    marked = lines.withColumn("centre", centre)
    gap = F.abs(F.col("centre") - F.lag("centre").over(order))
    joins = gap < same_row * F.greatest("height", F.lag("height").over(order))
    rows = marked.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("row", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = rows.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("x", "centre", "pos", "text"))).alias("c"))
    joined = cells.select("doc", "row", F.array_join(F.transform("c", lambda z: z["text"]), "\t").alias("line"))
    return joined.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda z: z["line"]), "\n").alias("text"), F.count("*").alias("rows"))


def text_objects(words: DataFrame) -> DataFrame:
    """Words ``(doc, pos, text, line_y)`` that are not blank with ``object``, from 1: a new one begins where the line's height changes."""
    order = Window.partitionBy("doc").orderBy("pos")
    shown = words.where(F.col("text").rlike(r"[^\s\p{Z}]"))
    starts = shown.withColumn("__new", F.when(F.lag("line_y").over(order) == F.col("line_y"), 0).otherwise(1))
    return starts.withColumn("object", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def reading_order(words: DataFrame) -> DataFrame:
    """Words ``(doc, pos, x, y, height)`` with ``place``, from 1: by the height of their centres, then from the left."""
    order = Window.partitionBy("doc").orderBy(F.col("y") + F.col("height") / 2, "x", "pos")
    return words.withColumn("place", F.row_number().over(order))


def placed_stamps(placements: DataFrame, pages: DataFrame) -> DataFrame:
    """Placements ``(doc, page, ...)`` with ``error``: a stamp for a page that its document does not have."""
    there = pages.select("doc", "page").distinct().withColumn("__there", F.lit(True))
    missing = F.when(F.col("__there").isNull(), F.concat(F.lit("stamp page "), F.col("page").cast("string"), F.lit(" does not exist")))
    return placements.join(there, ["doc", "page"], "left").withColumn("error", missing).drop("__there")


def outline_links(items: DataFrame) -> DataFrame:
    """Previous and next item of each outline item ``(doc, parent, item)`` under its parent."""
    order = Window.partitionBy("doc", "parent").orderBy("item")
    return items.withColumn("previous", F.lag("item").over(order)).withColumn("next", F.lead("item").over(order))


def merge_documents(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of the sources ``(doc, seq)`` as one document: their numbers follow the sources' order.

    Offsets come from the page counts, a row per source, so pages are not sorted together.
    Sources are dealt into ranges of ``seq``; the pages of the ranges before it (one
    number for each) are added to each source's offset in its own.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Any edges give right offsets; these, of a few sources by hash, make ranges of like size.
    some = sorted(r.seq for r in sources.where("seq is not null").select("seq").orderBy(F.xxhash64("seq")).limit(20 * parts).collect())
    edges = some[20::20]
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("seq"))) if edges else F.lit(0)
    counts = page_counts(pages).join(sources, "doc").withColumn("__range", below)
    earlier = Window.unboundedPreceding, -1
    before = counts.groupBy("__range").agg(F.sum("pages").alias("n")).select("__range", F.sum("n").over(Window.orderBy("__range").rowsBetween(*earlier)).alias("before"))
    own = counts.withColumn("own", F.sum("pages").over(Window.partitionBy("__range").orderBy("seq", "doc").rowsBetween(*earlier)))
    offsets = own.join(F.broadcast(before), "__range").select("doc", "seq", (F.coalesce("own", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("offset"))
    return pages.join(offsets, "doc").withColumn("merged_page", F.col("page") + F.col("offset")).drop("offset")
