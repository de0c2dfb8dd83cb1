"""Members of ZIP archives as tables: directories read by range, contents read only when selected.

``members`` reads the end and the central directory of each archive, a row a member.
Selection, order and budgets are filters, ranks and running sums over that table.
``contents`` then sorts what is left by archive and offset, reads neighbours at one go, and
inflates each under a limit.  An archive or member that cannot be read is a row with an
error.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.functions import names
from leafmill.operators.sinks import filesystem
from leafmill.sources.archives import ARCHIVE_BYTES, ENTRY_BYTES

GAP, PIECE = 64 << 10, 32 << 20  # neighbours so near are read together, up to so much
MEMBER = "name string, offset bigint, method int, encrypted boolean, crc bigint, compressed bigint, size bigint"
_MEMBER_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())


class Counted(io.RawIOBase):
    """A file opened for ranged reads that counts the bytes it hands out."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = None
        self.file, self.read_bytes = fs.open_input_file(path), 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, place: int, whence: int = 0) -> int:
        place += (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("a place before the file's start")
        return self.file.seek(place)

    def read(self, n: int = -1) -> bytes:
        raw = self.file.read() if n is None or n < 0 else self.file.read(n)
        self.read_bytes += len(raw)
        return raw

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        super().close()


def members(archives: DataFrame) -> DataFrame:
    """``(path, name, offset, method, encrypted, crc, compressed, size, read_bytes, error)`` of the files in archives ``(path)``.

    ``read_bytes`` (of the whole directory) stands with the first member; an archive without any, or one that
    cannot be read, has one row without a name.
    """

    def directory(path: str) -> tuple[list[tuple], int]:
        with Counted(*filesystem(path)) as file, zipfile.ZipFile(file) as archive:
            found = [(i.filename, i.header_offset, i.compress_type, bool(i.flag_bits & 1), i.CRC, i.compress_size, i.file_size) for i in archive.infolist() if not i.is_dir()]
            return found, file.read_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    rows, read = directory(path)
                    error = None
                except Exception as problem:
                    rows, read, error = [], 0, f"{type(problem).__name__}: {problem}"
                rows = rows or [(None,) * len(_MEMBER_TYPES)]
                n = len(rows)
                columns = [pa.array([path] * n, pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows), _MEMBER_TYPES)), pa.array([read, *[0] * (n - 1)], pa.int64()), pa.array([error] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "offset", "method", "encrypted", "crc", "compressed", "size", "read_bytes", "error"])

    return archives.select("path").mapInArrow(run, f"path string, {MEMBER}, read_bytes bigint, error string")


def images(listed: DataFrame, budget: int = ARCHIVE_BYTES) -> DataFrame:
    """Members that are pages of a comic: images that are not hidden, with ``page`` in natural order and ``error`` from where their sizes pass a budget."""
    files = listed.where(F.col("name").isNotNull() & ~names.is_hidden_member(F.col("name")))
    known = names.with_format(files, "name").where(F.col("format").isin(*names.IMAGES))
    order = Window.partitionBy("path").orderBy(names.natural_key(F.col("name")), "name", "offset")
    used = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("page", F.row_number().over(order)).withColumn("error", F.when(used > budget, f"images exceed {budget} bytes"))


def found(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members that ``wanted (path, name)`` names, with backslashes read as slashes if there is such a member, else as it stands; the last of equal names."""
    last = listed.where("name is not null").groupBy("path", "name").agg(F.max_by(F.struct(*(c for c in listed.columns if c not in ("path", "name"))), "offset").alias("m"))
    asked = wanted.select("path", F.col("name").alias("wanted"), F.replace("name", F.lit("\\"), F.lit("/")).alias("name"))
    slashed = asked.join(last, ["path", "name"])
    other = asked.join(slashed.select("path", "wanted"), ["path", "wanted"], "left_anti").select("path", "wanted", F.col("wanted").alias("name"))
    every = slashed.select("path", "wanted", "name", "m").union(other.join(last, ["path", "name"]).select("path", "wanted", "name", "m"))
    return every.select("path", "wanted", "name", "m.*")


def inflated(raw: bytes, method: int, size_limit: int) -> bytes:
    """The content of a member from its own bytes; more than ``size_limit`` is an error, whatever the directory says."""
    if method == zipfile.ZIP_STORED:
        content = raw
    elif method == zipfile.ZIP_DEFLATED:
        stream = zlib.decompressobj(-15)
        content = stream.decompress(raw, size_limit + 1)
        if len(content) <= size_limit and not stream.eof:
            raise ValueError("the member's data ends early")
    else:
        raise ValueError(f"compression method {method}")
    if len(content) > size_limit:
        raise ValueError(f"a member of more than {size_limit} bytes")
    return content


def contents(selected: DataFrame, *, entry_bytes: int = ENTRY_BYTES) -> DataFrame:
    """Rows of ``members`` (and any other columns) with ``content``, the ``read_bytes`` of its range, and ``error``.

    Rows that have an error already are passed on without being read.  Neighbours in an
    archive, selected or not, are read at one go where gaps are small; the first of them
    counts the bytes.
    """
    added = {"content", "read_bytes", "error"}
    kept = [f for f in selected.schema if f.name not in added]
    columns = [f.name for f in kept]
    before = F.col("error") if "error" in selected.columns else F.lit(None).cast("string")
    rows = selected.select(*columns, before.alias("error"))

    def content(raw: memoryview, row: dict) -> bytes:
        if bytes(raw[:4]) != b"PK\x03\x04":
            raise ValueError("no member starts here")
        start = 30 + int.from_bytes(raw[26:28], "little") + int.from_bytes(raw[28:30], "little")
        if row["encrypted"]:
            raise ValueError("an encrypted member")
        if start + row["compressed"] > len(raw):
            raise ValueError("the archive ends early")
        made = inflated(bytes(raw[start : start + row["compressed"]]), row["method"], entry_bytes)
        if zlib.crc32(made) != row["crc"]:
            raise ValueError("wrong checksum")
        return made

    def spans(batch: list[dict]) -> Iterator[list[dict]]:
        """Rows in runs that are read at one go."""
        run: list[dict] = []
        for row in batch:
            start = row["offset"] if row["error"] is None else None
            if run and (start is None or run[0]["error"] or row["path"] != run[0]["path"] or start - _end(run[-1]) > GAP or _end(row) - run[0]["offset"] > PIECE):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in spans(batch.to_pylist()):
                told = [(None, 0, r["error"]) for r in own] if own[0]["error"] else list(_read(own, content))
                schema = pa.schema([*(batch.schema.field(c) for c in columns), ("content", pa.binary()), ("read_bytes", pa.int64()), ("error", pa.string())])
                made = [pa.array([r[c] for r in own], batch.schema.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays([*made, *(pa.array(x, t) for x, t in zip(zip(*told), (pa.binary(), pa.int64(), pa.string())))], schema=schema)

    ordered = rows.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(run, StructType([*kept, *StructType.fromDDL("content binary, read_bytes bigint, error string")]))


def _end(row: dict) -> int:
    """Where a member ends at the latest, if its own header is not far longer than that in the directory."""
    return row["offset"] + 30 + len(row["name"].encode()) + 256 + row["compressed"]


def _read(own: list[dict], content) -> Iterator[tuple[bytes | None, int, str | None]]:
    """(content, bytes read, error) of members of one archive that are read at one go."""
    first, read = own[0]["offset"], 0
    try:
        with Counted(*filesystem(own[0]["path"])) as file:
            file.seek(first)
            raw = file.read(max(map(_end, own)) - first)
            head = raw[own[-1]["offset"] - first :][:30]
            longer = own[-1]["offset"] - first + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little") + own[-1]["compressed"] - len(raw)
            raw += file.read(longer) if longer > 0 else b""
            read = file.read_bytes
        problem = None
    except Exception as broken:
        problem = f"{type(broken).__name__}: {broken}"
    for n, row in enumerate(own):
        if problem:
            yield None, 0, problem
            continue
        try:
            yield content(memoryview(raw)[row["offset"] - first :], row), 0 if n else read, None
        except Exception as broken:
            yield None, 0 if n else read, f"{type(broken).__name__}: {broken}"


def pack(rows: DataFrame, *, level: int = 6) -> DataFrame:
    """Archives written from rows ``(path, name, content)``, an archive a group: ``(path, members, bytes)``."""

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("name")
        path, out = table.column("path")[0].as_py(), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as archive:
            for name, content in zip(table.column("name").to_pylist(), table.column("content").to_pylist()):
                archive.writestr(zipfile.ZipInfo(name), content or b"", compress_type=zipfile.ZIP_DEFLATED)
        fs, at = filesystem(path)
        fs.create_dir(at.rpartition("/")[0] or ".", recursive=True)
        part = f"{at}.{zlib.crc32(out.getbuffer()):08x}.part"
        with fs.open_output_stream(part) as sink:
            sink.write(out.getbuffer())
        fs.move(part, at)
        return pa.table({"path": pa.array([path], pa.string()), "members": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([out.tell()], pa.int64())})

    return rows.select("path", "name", "content").groupBy("path").applyInArrow(write, "path string, members bigint, bytes bigint")
