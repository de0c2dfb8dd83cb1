"""Operators on images and their drawings: rows ``(doc, page, draw_pos, image, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry

#: Resolution and quality of each step of fitting a size, gentlest first.
LADDER = ((300, 85), (200, 80), (150, 75), (150, 65), (120, 60), (100, 55), (100, 45), (85, 40), (72, 35))


def largest_drawing(drawings: DataFrame, area: str = "area") -> DataFrame:
    """Of each image, the drawing of the largest area; the first of equals."""
    row = F.struct("page", "draw_pos", F.col(area).alias("area"))
    return drawings.groupBy("doc", "image").agg(F.max_by(row, F.struct(F.col(area), -F.col("page"), -F.col("draw_pos"))).alias("d")).select("doc", "image", "d.*")


def drawn_extent(drawings: DataFrame) -> DataFrame:
    """Largest drawn width and, independently, height of each image."""
    return drawings.groupBy("doc", "image").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def image_targets(sizes: DataFrame) -> DataFrame:
    """Of the target sizes of an image on several pages, the widest; the first page of equals."""
    row = F.struct("page", "target_width", "target_height")
    return sizes.groupBy("doc", "image").agg(F.max_by(row, F.struct(F.col("target_width"), -F.col("page"))).alias("t")).select("doc", "image", "t.*")


def largest_image(images: DataFrame) -> DataFrame:
    """The largest image of a page; the last of equals."""
    return images.groupBy("doc", "page").agg(F.max_by("image", F.struct("area", "pos")).alias("image"), F.max("area").alias("area"))


def largest_decodable(images: DataFrame) -> DataFrame:
    """The largest image of a page whose decoding gave no error; pages without one are left out."""
    return largest_image(images.where("error is null"))


def labelled_images(images: DataFrame, least_area: int = 0) -> DataFrame:
    """``page_p`` or ``page_p_image_i``, i by area from the largest, of the images of at least an area."""
    kept = images.where(F.col("area") >= least_area)
    rank = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.col("area").desc(), "pos"))
    several = F.count("*").over(Window.partitionBy("doc", "page")) > 1
    name = F.concat(F.lit("page_"), F.col("page").cast("string"))
    return kept.withColumn("rank", rank).withColumn("label", F.when(several, F.concat(name, F.lit("_image_"), F.col("rank").cast("string"))).otherwise(name))


def blank_sheets(pixels: DataFrame, difference: int = 50, share: float = 0.0025) -> DataFrame:
    """Whether nearly every pixel ``(doc, value)`` has the paper's tone, the lower median."""
    levels = pixels.groupBy("doc", "value").agg(F.count("*").alias("n"))  # as many rows a sheet as there are tones
    level = F.array_sort(F.collect_list(F.struct("value", "n")))
    sheets = levels.groupBy("doc").agg(level.alias("levels"), F.sum("n").alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(pixels.schema["value"].dataType).alias("tone"))
    step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["tone"].isNull() & ((a["seen"] + x["n"]) * 2 >= F.col("all")), x["value"]).otherwise(a["tone"]).alias("tone"))
    sheets = sheets.withColumn("paper", F.aggregate("levels", start, step)["tone"].cast("int"))
    ink = F.aggregate("levels", F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.abs(x["value"] - F.col("paper")) > difference, x["n"]).otherwise(0))
    return sheets.select("doc", "paper", (ink / F.col("all") <= share).alias("blank"))


def contrast_range(pixels: DataFrame, spread: int = 32) -> DataFrame:
    """Darkest and lightest level beyond a hundredth of the pixels at either end; null where the sheet is uniform."""
    levels = pixels.groupBy("doc", "value").agg(F.count("*").alias("n"))
    up = Window.partitionBy("doc").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("doc").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.floor(F.sum("n").over(Window.partitionBy("doc")) / 100)
    seen = levels.withColumn("a", F.sum("n").over(up) > cut).withColumn("b", F.sum("n").over(down) > cut)
    found = seen.groupBy("doc").agg(F.min(F.when(F.col("a"), F.col("value"))).alias("low"), F.max(F.when(F.col("b"), F.col("value"))).alias("high"))
    return found.withColumn("stretched", F.col("high") >= F.col("low") + spread)


def colour_classes(pixels: DataFrame, few: int = 256, spread: int = 24) -> DataFrame:
    """Few colours, and effectively gray, of pixels ``(doc, r, g, b)``."""
    wide = F.greatest("r", "g", "b") - F.least("r", "g", "b") > spread
    return pixels.groupBy("doc").agg(
        F.count_distinct("r", "g", "b").alias("colours"),
        (F.count_distinct("r", "g", "b") <= few).alias("few_colours"),
        (F.count_if(wide) <= F.floor(F.count("*") / 5000)).alias("gray"),
    )


def size_step(sizes: Column, limit: Column) -> Column:
    """Number (from 0) of the gentlest step whose size fits; -1 if the plain size does, null if none does.

    ``sizes`` holds the plain size and then that of each admitted step.
    """
    fits = F.array_position(F.transform(sizes, lambda s: s <= limit), F.lit(True)).cast("int")
    return F.when(fits > 0, fits - 2)


def ladder(base_dpi: int = 300, quality: int = 85) -> list[tuple[int, int]]:
    return [s for s in LADDER if s[0] <= base_dpi and s[1] <= quality]


def upright_turns(rises: Column) -> Column:
    """Quarter turns (0 to 3) by the largest of four rises; the last of equals."""
    pairs = F.transform(rises, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    return F.array_max(pairs)["i"]


def placement_plan(images: DataFrame, dpi: int) -> DataFrame:
    """What images drawn at ``(width, height)`` points shrink to at a resolution; those that do not are left out."""
    target = geometry.fit_for_placement(F.col("pixel_width"), F.col("pixel_height"), F.col("width"), F.col("height"), F.lit(dpi))
    return images.withColumn("t", target).where("t is not null").select("*", F.col("t.width").alias("target_width"), F.col("t.height").alias("target_height")).drop("t")


def unsafe_reason(mask: Column, stencil: Column, decode: Column, bits: Column) -> Column:
    """Why an image is not resampled; null if it may be."""
    return F.when(mask, "mask").when(stencil, "stencil").when(decode, "decode").when(F.coalesce(bits, F.lit(8)) != 8, "bits")


def kept_smaller(old: Column, new: Column, required: Column) -> Column:
    """Whether a replacement is taken: when smaller, or when it must be."""
    return required | (new < old)
