"""An invisible layer of recognised words over the image of a page.

A font is a table of its characters' glyphs and advances (as many rows as Unicode has
characters at most, some 30 MB, so each task may hold it).  The width of a text is the sum
over its characters; the place, size and stretching of a word are columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.geometry import matrix_product
from leafmill.operators.pages import text_objects

#: The smallest size of a word, lines of a page of unplaced text, and their distance in sizes.
LEAST_SIZE, FALLBACK_LINES, LEADING = 4.0, 70.0, 1.25


def font_table(spark: SparkSession, font) -> DataFrame:
    """``(character, glyph, advance)`` of a ``sources.fonts.Font``, advances as shares of the size."""
    rows = [(chr(c), g, font.advances[min(g, font.glyphs - 1)] / font.units) for c, g in font.map.items()]
    return spark.createDataFrame(rows, "character string, glyph int, advance double")


def with_widths(words: DataFrame, text: str, font: DataFrame, missing: float) -> DataFrame:
    """``words`` with ``ems`` and ``glyphs`` in place of ``text``: width as a share of the size, and glyph numbers in hexadecimal; other characters are glyph 0, ``missing`` wide.

    The font goes to the tasks, so texts are measured where they lie.
    """
    known = [(ord(r.character), r.glyph or 0, missing if r.advance is None else r.advance) for r in font.where("char_length(character) = 1").select("character", "glyph", "advance").collect()]
    kept = [c for c in words.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(0x110000, len(known), np.int32)
        place[np.array([c for c, _, _ in known], np.int64)] = np.arange(len(known))
        advances = np.array([*(a for _, _, a in known), missing], np.float64)
        codes = np.array([*(f"{g:04X}"[:4] for _, g, _ in known), "0000"], "S4")
        for batch in batches:
            ems, glyphs = [], []
            for shown in batch.column(text).to_pylist():
                at = place[np.frombuffer((shown or "").encode("utf-32-le"), np.uint32)]
                ems.append(float(np.cumsum(advances[at])[-1]) if len(at) else 0.0)  # in order, so equal texts have equal widths
                glyphs.append(codes[at].tobytes().decode("ascii"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ems, pa.float64()), pa.array(glyphs, pa.string())], names=[*kept, "ems", "glyphs"])

    return words.mapInArrow(run, words.select(*kept).schema.add("ems", "double").add("glyphs", "string"))


def placed_words(words: DataFrame, font: DataFrame, ascent: float, missing: float = 0.5) -> DataFrame:
    """Words ``(doc, pos, text, x, line_y, line_height, height, width, area_height)`` that are not blank, with ``object``, ``size``, ``baseline``, ``stretch`` (in percent) and ``glyphs`` (of the word and a space).

    A line has one size; its baseline stands ``ascent`` sizes under its top; a word is
    stretched to its box.  Heights count upwards from the foot of the area.
    """
    spaced = F.concat("text", F.lit(" "))
    shown = text_objects(words).withColumn("text", spaced)
    size = F.greatest("line_height", "height", F.lit(LEAST_SIZE))
    natural = F.col("ems") * F.col("size")
    sized = with_widths(shown, "text", font, missing).withColumn("size", size)
    return sized.select(
        "doc",
        "pos",
        "object",
        "x",
        "size",
        (F.col("area_height") - F.col("line_y") - F.col("size") * ascent).alias("baseline"),
        F.when(natural > 0, F.col("width") / natural * 100).otherwise(100.0).alias("stretch"),
        "glyphs",
    )


def unplaced_lines(lines: DataFrame) -> DataFrame:
    """Lines ``(doc, pos, text, area_height)`` of a text without places, from 0, with ``size``, ``x`` and ``y``: as many as the area holds, at least the first."""
    size = F.col("area_height") / FALLBACK_LINES
    y = F.col("area_height") - size * 2 - size - F.col("pos") * (size * LEADING)
    made = lines.select("doc", "pos", "text", size.alias("size"), (size * 2).alias("x"), y.alias("y"))
    return made.where((F.col("pos") == 0) | (F.col("y") >= F.col("x"))).where(F.col("text").rlike(r"[^\s\p{Z}]"))


def area_matrix(turns: Column, width: Column, height: Column, placement: Column) -> tuple[Column, Column, Column]:
    """(matrix, width, height) of the area that words of an image turned clockwise by ``turns`` quarters stand in; ``placement`` puts the upright image on its page."""
    one, zero = F.lit(1.0), F.lit(0.0)
    w, h = F.greatest(width.cast("double"), one), F.greatest(height.cast("double"), one)
    quarter = F.pmod(turns, F.lit(4))
    unit = (
        F.when(quarter == 1, F.array(zero, one / h, -one / w, zero, one, zero))
        .when(quarter == 2, F.array(-one / w, zero, zero, -one / h, one, one))
        .when(quarter == 3, F.array(zero, -one / h, one / w, zero, zero, one))
        .otherwise(F.array(one / w, zero, zero, one / h, zero, zero))
    )
    odd = quarter % 2 == 1
    return matrix_product(unit, placement), F.when(odd, h).otherwise(w), F.when(odd, w).otherwise(h)


def layer(placed: DataFrame, areas: DataFrame, font_name: str) -> DataFrame:
    """``(doc, content)``: the layer's operators, for ``placed_words`` and ``areas (doc, matrix)``; a text object for each line."""
    new = F.col("object") != F.lag("object").over(Window.partitionBy("doc").orderBy("pos"))
    shown = F.format_string(f"%.1f Tz\n/{font_name} %.3f Tf\n1 0 0 1 %.3f %.3f Tm\n<%s> Tj\n", "stretch", "size", "x", "baseline", "glyphs")
    lines = placed.withColumn("line", F.concat(F.when(new, "ET\nBT\n").otherwise(""), shown))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    whole = lines.groupBy("doc").agg(words.alias("words")).join(areas.select("doc", "matrix"), "doc")
    head = F.format_string("\nq\n%.8f %.8f %.8f %.8f %.3f %.3f cm\nBT\n3 Tr\n", *(F.get("matrix", i) for i in range(6)))
    return whole.select("doc", F.concat(head, "words", F.lit("100 Tz\nET\nQ\n")).alias("content"))
