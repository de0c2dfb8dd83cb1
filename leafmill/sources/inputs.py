"""Inputs of a command: a data source that lists folders, and arguments expanded by joins.

``leafmill_files`` lists folders, one partition each, and takes filters on ``format``
and ``name`` into the listing (with ``spark.sql.python.filterPushdown.enabled``).
``expanded`` joins a table of entries, however many lists they come from, with a table of
files; ``expand`` makes both from arguments.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from leafmill.functions import names
from leafmill.operators.graphs import numbered

_FORMAT_OF = {e: f for f, es in names.EXTENSIONS.items() for e in es.split()}
FILES = "folder string, path string, name string, format string, length bigint"


def format_of(name: str) -> str | None:
    """The format that a file's name tells, as ``names.with_format`` has it."""
    low = name.lower()
    if low.endswith(".fb2.zip") and len(low) > 8:
        return "fb2"
    stem, dot, ending = low.rpartition(".")
    return _FORMAT_OF.get(ending) if dot and stem else None


def _opened(folder: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a folder, its path there, and what stands before such paths in names."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder or ".", ""
    fs, at = pafs.FileSystem.from_uri(folder)
    parts = urlsplit(folder)
    return fs, at, "" if parts.scheme == "file" else f"{parts.scheme}://{parts.netloc}"


def listing(folder: str, deep: bool = False) -> Iterator[pafs.FileInfo]:
    """The regular files of a folder; nothing if it is none."""
    fs, at, _ = _opened(folder)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        yield from (f for f in fs.get_file_info(pafs.FileSelector(at, recursive=deep)) if f.type == pafs.FileType.File)


class Folder(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class FolderReader(DataSourceReader):
    """Lists a folder a partition, and leaves out what its filters do not let through."""

    def __init__(self, folders: list[str]):
        self.folders, self.formats, self.starts, self.ends = folders, None, [], []

    def partitions(self) -> list[InputPartition]:
        return [Folder(f) for f in self.folders]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows = []
        for f in listing(partition.folder):
            format_ = format_of(f.base_name)
            if self.formats is not None and format_ not in self.formats:
                continue
            if all(f.base_name.startswith(x) for x in self.starts) and all(f.base_name.endswith(x) for x in self.ends):
                rows.append((partition.folder, _opened(partition.folder)[2] + f.path, f.base_name, format_, f.size))
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 4 + (pa.int64(),))], names=["folder", "path", "name", "format", "length"])


class FilteringReader(FolderReader):
    """Takes filters on the format, and on how names begin and end; Spark wants no such method where push-down is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("format",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.formats = wanted if self.formats is None else self.formats & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("name",):
                self.ends.append(f.value)
            else:
                yield f


class FolderSource(DataSource):
    """Option ``path``: a folder; or ``folders``: a JSON list of them; ``pushdown``: whether the session lets Python sources filter."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        folders = json.loads(self.options["folders"]) if "folders" in self.options else [self.options["path"]]
        return (FilteringReader if self.options.get("pushdown") == "true" else FolderReader)(folders)


def files(spark: SparkSession, folders: list[str], command: str = "merge") -> DataFrame:
    """``(folder, path, name, format, length)`` of the files in folders that a command admits, without lock files."""
    spark.dataSource.register(FolderSource)
    rows = spark.read.format("leafmill_files").option("folders", json.dumps(folders)).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()
    return admitted(rows, command).where(~F.col("name").startswith("~$"))


def admitted(rows: DataFrame, command: str) -> DataFrame:
    return rows.where(F.col("format").isin(*names.ADMITTED[command]) if command in names.ADMITTED else F.col("format").isNotNull())


def glob_pattern(glob: Column) -> Column:
    """A regular expression for ``*``, ``?``, ``[...]`` in a part of a path, and ``**/`` for any folders."""
    plain = F.regexp_replace(F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1"), r"\[(?![^\]/]+\])", r"\\[")
    steps = [("[!", "[^"), ("**/", "\x01"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:[^/]+/)*")]
    for old, new in steps:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return plain


def located(entries: DataFrame) -> DataFrame:
    """Entries ``(arg, line, entry, base, pages)`` with ``path`` (below ``base`` unless absolute), ``pages`` (their own first), ``glob``, ``deep``, ``head`` and ``pattern``.

    ``head`` is the folder in which a pattern's first wild card stands; a ``deep`` one has them in names of folders.
    """
    path, own = names.split_page_range(F.col("entry"))
    absolute = F.col("__path").startswith("/") | F.col("__path").contains("://")
    before = F.when(absolute | (F.coalesce("base", F.lit("")) == ""), "").otherwise(F.concat(F.regexp_replace("base", "/+$", ""), F.lit("/")))
    rows = entries.select("arg", "line", "base", path.alias("__path"), F.coalesce(own, F.col("pages")).alias("pages")).withColumn("__before", before)
    head = F.regexp_replace(F.concat("__before", F.regexp_extract("__path", r"^([^*?\[]*/)?", 1)), "(?<=.)/$", "")
    return rows.select(
        "arg",
        "line",
        F.regexp_replace(F.concat("__before", "__path"), "(?<=.)/+$", "").alias("path"),
        "pages",
        F.col("__path").rlike(r"[*?]").alias("glob"),
        F.col("__path").rlike(r"[*?\[][^/]*/").alias("deep"),
        head.alias("head"),
        F.concat(F.lit("^\\Q"), "__before", F.lit("\\E"), glob_pattern(F.col("__path")), F.lit("$")).alias("pattern"),
    )


def expanded(entries: DataFrame, paths: DataFrame, folders: DataFrame | None = None, command: str = "merge") -> DataFrame:
    """``(arg, seq, path, pages)`` of entries ``(arg, line, entry, base, pages)`` against the ``paths (path)`` and ``folders (path)`` that exist.

    A folder stands for its files, a glob for those it fits (both: files that the command
    admits, without lock files, in natural order); any other entry stands for itself.
    Arguments come in order, then lines.  A row of ``folders`` is needed for empty ones alone.
    """
    where = located(entries)
    known = admitted(names.with_format(paths.select("path").distinct()), command).where(~names.is_lock_file(F.col("path"))).select("path")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    inside = lambda rows: rows.select(F.col("path").alias("file"), F.explode(F.when(F.size(steps) > 1, above).otherwise(F.array(F.lit("")))).alias("folder"))
    parent = F.regexp_replace("file", "/?[^/]*$", "")
    exist = inside(paths).select("folder") if folders is None else inside(paths).select("folder").union(folders.select(F.regexp_replace("path", "(?<=.)/+$", "")))
    marked = where.join(exist.distinct().withColumnRenamed("folder", "path").withColumn("is_folder", F.lit(True)), "path", "left")
    marked = marked.withColumn("kind", F.when(F.col("is_folder"), "folder").when(F.col("glob"), "glob").otherwise("file"))
    own = marked.where("kind = 'folder'").join(inside(known).where(parent == F.col("folder")), F.col("path") == F.col("folder"))
    fitting = marked.where("kind = 'glob'").join(inside(known), F.col("head") == F.col("folder")).where(F.expr("file rlike pattern"))
    found = marked.where("kind = 'file'").select("arg", "line", F.col("path").alias("file"), "pages")
    for part in (own, fitting):
        found = found.union(part.select("arg", "line", "file", "pages"))
    order = [F.col("line"), names.natural_key(F.col("file")), F.col("file"), F.coalesce("pages", F.lit(""))]
    places = numbered(found.withColumnRenamed("arg", "doc"), order, "seq")
    return places.select(F.col("doc").alias("arg"), "seq", F.col("file").alias("path"), "pages")


def list_entries(spark: SparkSession, lists: DataFrame) -> DataFrame:
    """``(arg, line, entry, base, pages)`` of input lists ``(arg, path, pages)``: blank lines, ``#`` comments and a byte-order mark left out.

    Lists are read in tasks, a list a task, as a stream of lines; entries are relative to
    their list's folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at, _ = _opened(row["path"])
                with fs.open_input_stream(at) as raw:
                    lines, rest, number = [], b"", 0
                    while piece := raw.read(1 << 20):
                        *whole, rest = (rest + piece).split(b"\n")
                        lines = whole
                        yield entries(row, lines, number)
                        number += len(lines)
                    yield entries(row, [rest], number)

    def entries(row: dict, lines: list[bytes], number: int) -> pa.RecordBatch:
        texts = [(number + i, x.decode("utf-8-sig" if number + i == 0 else "utf-8", "replace").strip()) for i, x in enumerate(lines)]
        kept = [(n, t) for n, t in texts if t and not t.startswith("#")]
        n = len(kept)
        columns = [pa.array([row["arg"]] * n, pa.int32()), pa.array([k for k, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.string()), pa.array([posixpath.dirname(row["path"])] * n, pa.string()), pa.array([row["pages"]] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["arg", "line", "entry", "base", "pages"])

    return lists.select("arg", "path", "pages").mapInArrow(run, "arg int, line bigint, entry string, base string, pages string")


def _existing(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, folders) that entries may stand for, listed in tasks, each folder once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, deep in zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist()):
                fs, at, before = _opened(folder)
                if fs.get_file_info(at).type != pafs.FileType.Directory:
                    continue
                found = [before + f.path.removeprefix("./") for f in listing(folder, deep)]
                yield pa.RecordBatch.from_arrays([pa.array([folder, *[None] * len(found)], pa.string()), pa.array([None, *found], pa.string())], names=["folder", "path"])

    where = located(entries)
    heads = where.where("glob").select(F.when(F.col("head") == "", ".").otherwise(F.col("head")).alias("folder"), "deep")
    wanted = heads.union(where.select(F.col("path").alias("folder"), F.lit(False))).groupBy("folder").agg(F.max("deep").alias("deep"))
    listed = wanted.mapInArrow(run, "folder string, path string")
    return listed.where("path is not null").select("path"), listed.where("folder is not null").select(F.col("folder").alias("path"))


def expand(spark: SparkSession, arguments: list[str], command: str = "merge") -> DataFrame:
    """``(arg, seq, path, pages)`` of a command's arguments: folders, globs, ``@lists`` and plain paths; nothing found is an error."""
    given = spark.createDataFrame([(n, a.startswith("@"), a.removeprefix("@")) for n, a in enumerate(arguments)], "arg int, is_list boolean, entry string")
    path, pages = names.split_page_range(F.col("entry"))
    entries = given.where("not is_list").select("arg", F.lit(0).cast("bigint").alias("line"), "entry", F.lit("").alias("base"), F.lit(None).cast("string").alias("pages"))
    if any(a.startswith("@") for a in arguments):
        entries = entries.union(list_entries(spark, given.where("is_list").select("arg", path.alias("path"), pages.alias("pages"))))
    found = expanded(entries, *_existing(entries), command)
    if found.isEmpty():
        raise ValueError("no input files found")
    return found
