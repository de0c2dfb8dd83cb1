"""Names of files and of outputs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions by format, as the formats' names stand for them.
EXTENSIONS = {
    "jpeg": "jpg jpeg jpe jfif",
    "png": "png",
    "raster": "bmp gif tiff tif webp apng",
    "system_raster": "heic heif avif jxl",
    "psd": "psd psb",
    "ffmpeg_raster": "dds exr hdr qoi tga pcx pnm ppm pgm pbm pam sgi xbm jp2 j2k j2c jpc jpf jpx jls dpx fits fit fts pgx ras sun xwd pix",
    "wic_raster": "jxr wdp hdp ico",
    "camera_raw": "3fr arw bay cr2 cr3 crw dcr dng erf fff gpr iiq k25 kdc mef mos mrw nef nrw orf pef raf raw rw2 rwl sr2 srf srw x3f",
    "pdf": "pdf",
    "word": "doc docx rtf odt",
    "excel": "xls xlsx ods",
    "powerpoint": "ppt pptx pps ppsx odp",
    "epub": "epub",
    "fb2": "fb2",
    "html": "html htm xhtml",
    "svg": "svg",
    "htmlz": "htmlz",
    "cbz": "cbz",
    "text": "md txt json jsonc xml yaml yml log ini cfg csv tsv",
}
IMAGES = ("jpeg", "png", "raster", "ffmpeg_raster", "wic_raster", "system_raster", "psd", "camera_raw")
#: Formats that a listing admits, by command (merge admits all).
ADMITTED = {
    "ocr": (*IMAGES, "pdf"),
    "convert": (*IMAGES, "pdf", "html", "svg"),
    "strip": ("jpeg", "png", "pdf"),
    "rotate": ("pdf", "jpeg"),
    "resize": ("pdf", "jpeg"),
}


def format_dimension(spark: SparkSession) -> DataFrame:
    """One row per extension: format and its classes.  Its size is fixed, so joins may broadcast it."""
    rows = [(e, f, f in IMAGES, f in ("word", "excel", "powerpoint"), f in ("epub", "fb2", "htmlz")) for f, es in EXTENSIONS.items() for e in es.split()]
    return spark.createDataFrame(rows, "extension string, format string, is_image boolean, is_office boolean, is_ebook boolean")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, lower-cased; empty for names without one or with a leading one alone."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?[^/]*/*$", 1)


def lookup_key(path: Column) -> Column:
    """The extension under which the dimension lists a path (``.fb2.zip`` is an e-book)."""
    return F.when(F.lower(file_name(path)).rlike(r".\.fb2\.zip$"), "fb2").otherwise(extension(path))


def with_format(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the format that the name tells; null for unknown ones and plain archives."""
    dimension = format_dimension(files.sparkSession).withColumnRenamed("extension", "__extension")
    return files.join(F.broadcast(dimension), lookup_key(F.col(path)) == F.col("__extension"), "left").drop("__extension")


def is_lock_file(path: Column) -> Column:
    return file_name(path).startswith("~$")


def is_hidden_member(name: Column) -> Column:
    """A part of the archive path is ``__MACOSX`` or begins with a dot."""
    return F.exists(F.split(name, r"[/\\]"), lambda p: (p == "__MACOSX") | (p.startswith(".") & ~p.isin(".", "..")))


def natural_key(name: Column) -> Column:
    """Sort key: digit runs by value, then by fewer leading zeros; the rest by lower-cased code points."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(0))
    digits = lambda t: F.concat(F.lpad(F.length(F.ltrim(t, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(t, F.lit("0")), F.lpad(F.length(t).cast("string"), 10, "0"))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike("^[0-9]"), digits(t)).otherwise(t)), "")


def split_page_range(argument: Column) -> tuple[Column, Column]:
    """Path and page expression of ``file.pdf:1-3``; the last ``.pdf:`` counts, the expression is null without one."""
    found = argument.rlike(r"(?is)\.pdf:")
    return (
        F.when(found, F.regexp_extract(argument, r"(?is)^(.*\.pdf):(.*)$", 1)).otherwise(argument),
        F.when(found, F.regexp_extract(argument, r"(?is)^(.*\.pdf):(.*)$", 2)),
    )


def suffixed(path: Column, suffix: str, ending: Column | None = None) -> Column:
    """``stem_suffix.ext`` beside the path; ``pdf`` where it has no extension."""
    own = F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)
    ending = F.when(file_name(path).rlike(r"(?s)^.+\."), own).otherwise("pdf") if ending is None else ending
    return F.concat(parent(path), stem(path), F.lit(f"_{suffix}."), ending)


def edited_destination(path: Column, suffix: str, *, directory: str | None = None, in_place: bool = False) -> Column:
    """Where an edited file goes; null where that would silently replace its source."""
    if in_place:
        return path
    made = F.concat(F.lit(directory.rstrip("/") + "/"), file_name(path)) if directory else suffixed(path, suffix)
    return F.when(made != path, made)


def jpeg_name(path: Column, directory: str | None = None, tag: Column | None = None) -> Column:
    where = F.lit(directory.rstrip("/") + "/") if directory else parent(path)
    return F.concat(where, stem(path), *([F.lit("_"), tag] if tag is not None else []), F.lit(".jpg"))


def file_url(path: Column) -> Column:
    """``file:`` URL of an absolute path: all bytes but letters, digits and ``-._~/:`` as ``%XX``."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    pairs = F.regexp_extract_all(F.hex(slashed.cast("binary")), F.lit("(..)"), F.lit(1))
    plain = lambda x: F.decode(F.unhex(x), "ISO-8859-1")
    shown = F.transform(pairs, lambda x: F.when(plain(x).rlike("^[A-Za-z0-9._~/:-]$"), plain(x)).otherwise(F.concat(F.lit("%"), x)))
    return F.concat(F.when(slashed.startswith("/"), "file://").otherwise("file:///"), F.array_join(shown, ""))


def with_base(html: Column, url: Column, script: str = "") -> Column:
    """HTML with a base address after its head's, else root's, else type's tag (unless it has one), and a script at the end."""
    base = F.concat(F.lit('<base href="'), url, F.lit('">'))
    at = lambda name: F.length(F.regexp_extract(html, rf"(?is)^(.*?<{name}(?:\s[^>]*)?>)", 1))
    place = F.when(at("head") > 0, at("head")).when(at("html") > 0, at("html")).otherwise(at("!doctype"))
    made = F.concat(F.substring(html, F.lit(1), place), base, F.substring(html, place + 1, F.length(html)))
    return F.concat(F.when(F.instr(F.lower(html), "<base") > 0, html).otherwise(made), F.lit(script))


def number_list(values: Column) -> Column:
    """Numbers of an array with commas between, in its order."""
    return F.array_join(values.cast("array<string>"), ",")
