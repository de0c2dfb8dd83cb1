"""Unique names for many rows at once, as if they were given one after another.

In order, a row takes its path ``p`` if it is free, else the first free one of ``p_2``,
``p_3``, ... (the number at the stem).  Rows that want one path take its numbers in
ascending order, so a row's number is its place among them, and one more for each number
that is gone.  A number is gone if a file has it, or if an earlier row wanted that very
name and found it free.  Which of the two comes first is a join; since it depends on
numbers further down, the join is repeated until nothing changes.  Only names that some
row wants and that look like a numbered form of another wanted name take part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.graphs import numbered
from leafmill.sources.tables import written

_ENDING = r"(?s)[^/](\.[^./]*)$"


def _ending(path: Column) -> Column:
    """An extension with its dot; empty for names without one or with a leading dot alone."""
    return F.regexp_extract(path, _ENDING, 1)


def _stem(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(_ending(path)))


def _numbered_path(path: Column, number: Column) -> Column:
    return F.when(number < 2, path).otherwise(F.concat(_stem(path), F.lit("_"), number.cast("string"), _ending(path)))


def unique_paths(rows: DataFrame, path: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``file``: their path, or its first free numbered form, in ``order`` (a value of its own for each row).

    ``existing (path)`` files are taken from the start.  A null path has a null file.  A
    column called ``file`` is replaced.
    """
    kept = [c for c in rows.columns if c != "file"]
    wanted = rows.select(F.col(f"`{path}`").alias("doc"), F.col(f"`{order}`").alias("at")).where("doc is not null")
    placed = written(numbered(wanted, [F.col("at")], "place").select("doc", "at", "place"), "names-wanted")
    first = placed.where("place = 1").select("doc", F.col("at").alias("first"))
    old = (existing.select("path") if existing is not None else rows.sparkSession.createDataFrame([], "path string")).distinct()
    # Names that look like a numbered form of a wanted one: wanted themselves, or there already.
    digits = F.regexp_extract(_stem(F.col("name")), r"_([2-9]|[1-9][0-9]{1,17})$", 1)
    base = F.concat(F.regexp_extract(_stem(F.col("name")), r"(?s)^(.*)_[0-9]+$", 1), _ending(F.col("name")))
    named = first.select(F.col("doc").alias("name"), "first").join(old.withColumnRenamed("path", "name").withColumn("there", F.lit(True)), "name", "full")
    forms = named.where(digits != "").select("name", "first", F.coalesce("there", F.lit(False)).alias("there"), base.alias("doc"), digits.cast("bigint").alias("number"))
    forms = written(forms.join(first.select("doc"), "doc", "left_semi"), "names-forms")
    there = old.withColumnRenamed("path", "doc").join(first.select("doc"), "doc", "left_semi")

    lower = Window.partitionBy("doc").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    state = written(forms.select("doc", "number", "name", F.col("there").alias("gone"), F.lit(False).alias("given")), "names-state")
    while True:
        # the place of the row that would take a number, if all lower ones are as they are held to be
        held = state.join(_taken(there, state), "doc", "left")
        reach = held.withColumn("place", F.col("number") - F.coalesce("taken", F.lit(0)) - F.coalesce(F.sum(F.col("gone").cast("bigint")).over(lower), F.lit(0)))
        taker = reach.join(placed.withColumnRenamed("at", "taker"), ["doc", "place"], "left").join(forms.select("doc", "number", "first", "there"), ["doc", "number"])
        gone = F.col("there") | F.coalesce(F.col("first") < F.col("taker"), F.lit(False))
        given = ~F.col("there") & F.coalesce(F.col("taker") < F.col("first"), F.lit(False))
        new = written(taker.select("doc", "number", "name", gone.alias("now_gone"), given.alias("now_given"), (gone != F.col("gone")).alias("moved"), (given != F.col("given")).alias("moved_too")), "names-state")
        changed = not new.where("moved or moved_too").isEmpty()
        state = new.select("doc", "number", "name", F.col("now_gone").alias("gone"), F.col("now_given").alias("given"))
        if not changed:
            break
    lost = state.join(_taken(there, state), "doc", "left").where("gone")
    free_before = F.col("number") - 1 - F.coalesce("taken", F.lit(0)) - F.coalesce(F.count("*").over(lower), F.lit(0))
    gaps = lost.select("doc", free_before.alias("before")).groupBy("doc").agg(F.collect_list("before").alias("gaps"))
    found = placed.join(_taken(there, state), "doc", "left").join(gaps, "doc", "left")
    skipped = F.when(F.col("gaps").isNull(), 0).otherwise(F.size(F.filter("gaps", lambda g: g < F.col("place"))))
    number = F.col("place") + F.coalesce("taken", F.lit(0)) + skipped
    files = found.select(F.col("at").alias("__at"), _numbered_path(F.col("doc"), number).alias("file"))
    own = rows.select(*(F.col(f"`{c}`") for c in kept))
    return own.join(files, own[order] == files["__at"], "left").drop("__at")


def _taken(there: DataFrame, state: DataFrame) -> DataFrame:
    """``(doc, taken)`` of wanted paths that none of their rows can have: a file has it, or a row of a shorter name was given it."""
    return there.union(state.where("given").select(F.col("name"))).distinct().withColumn("taken", F.lit(1))
