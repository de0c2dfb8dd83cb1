"""WARC archives, index first.

Writing gives each page a record (gzip member of its own) and the index a row with
the record's file, offset, length, URL and payload digest.  Reading starts from the
index: the selected rows are sorted by file and offset, neighbouring byte ranges are
joined into reads of up to ``read_bytes``, and no byte outside of them is fetched.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest
page id is a response, the others are revisits that refer to it.  The groups come from
a pre-aggregated count by digest; the join back is a plain one of scans whose skewed
partitions adaptive execution splits, so a payload of a third of all rows is dealt over
many tasks.  Files are written under a name of their own and renamed.

Defined results: null html is an empty payload; a null or empty URL has no target
header; repeated rows of the smallest page id are all responses; rows with a null
page id are responses unless a row with an id has their payload; no rows give no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _store, _text

INDEX = "page_id bigint, url string, digest string, file string, offset bigint, length bigint"
#: Names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, own_digest: str, refers_to: int | None, date: str) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{own_digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one record (a revisit has no payload of its own)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, file_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the archives into ``folder`` and return their index, itself a table in the shared folder."""
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "html", 8 << 20):
                found = [digest(x.as_buffer().to_pybytes()) for x in part.column("html").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "digest"])

    hashed = rows.mapInArrow(digests, "page_id bigint, url string, html string, digest string")
    big = F.octet_length("html") >= min_bytes
    groups = hashed.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = hashed.join(_store.written(groups, "payload-groups"), "digest", "left")
    decided = joined.withColumn("refers_to", F.when(big & (F.col("first") != F.coalesce("page_id", F.col("first") - 1)), F.col("first"))).drop("first")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store.filesystem(folder)
        task, number, held, at = TaskContext.get().partitionId(), 0, [], 0
        index: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, at, index
            name = f"archive-{task:06d}-{number:04d}.warc.gz"
            _store.put_file(fs, f"{root}/{name}", b"".join(held))
            ids, urls, sums, offsets, lengths = zip(*index)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(sums, pa.string()), pa.array([f"{folder}/{name}"] * len(ids)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["page_id", "url", "digest", "file", "offset", "length"],
            )
            number, held, at, index = number + 1, [], 0, []

        for batch in batches:
            for part in _text.slices(batch, "html", 8 << 20):
                for page, link, text, own, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    press = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = press.compress(record(page, link, text.encode(), own, refers, date)) + press.flush()
                    index.append((page, link, own, at, len(member)))
                    held.append(member)
                    at += len(member)
                    if at >= file_bytes:
                        yield from flush()
        if index:
            yield from flush()

    return _store.written(decided.mapInArrow(store, INDEX), "warc-index")


def read(index: DataFrame, *, read_bytes: int = 4 << 20, gap: int = 64 << 10) -> DataFrame:
    """The records of the (selected) index rows: ids, URL, payload, its size and digest, type, and what a revisit refers to."""
    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            start = 0
            while start < len(rows):
                file, first, length = rows[start]
                stop, end = start + 1, first + length
                while stop < len(rows) and rows[stop][0] == file and 0 <= rows[stop][1] - end <= gap and rows[stop][1] + rows[stop][2] - first <= read_bytes:
                    end = rows[stop][1] + rows[stop][2]
                    stop += 1
                fs, path = _store.filesystem(file)
                with fs.open_input_file(path) as source:
                    raw = source.read_at(end - first, first)
                out = []
                for _, offset, size in rows[start:stop]:
                    own = parse(zlib.decompress(raw[offset - first : offset - first + size], 31))
                    number = lambda name: (lambda x: int(x) if x else None)(own["warc"].get(name, "<urn:page:>")[10:-1])
                    kind, sha = own["warc"]["WARC-Type"], own["warc"]["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(own["payload"]) != sha:
                        raise ValueError(f"{file}, offset {offset}: the payload does not fit its digest")
                    out.append((number("WARC-Record-ID"), own["warc"].get("WARC-Target-URI"), own["payload"] if kind == "response" else None, int(own["http"]["Content-Length"]), sha, kind, number("WARC-Refers-To")))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                start = stop

    dealt = index.withColumn("__block", (F.col("offset") / (8 << 20)).cast("bigint"))
    return dealt.repartition("file", "__block").sortWithinPartitions("file", "offset").mapInArrow(fetch, schema)
