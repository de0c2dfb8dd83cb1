"""Token-id files with directly addressable codes.

Each id is split into chunks of eight bits, the lowest first.  Level 0 holds the first
chunk of every id; a continuation bitmap tells which ids go on, and level k + 1 holds
the next chunk of those alone.  A rank directory (set bits before each 512) turns a
position on one level into that on the next, so any token, or any range of tokens, is
read by a few look-ups without decoding what stands before it.

File: magic, length of a JSON header (uint32), header, sections.  The header gives each
section's place: per level ``chunks``, ``bits`` and ``ranks``; ``keys`` (int64), ``null_keys``
and ``starts`` (int64, one more than the documents) of the documents.

Writing puts documents in ascending key order over numbered files: one or more for each
part of the key range (a task), begun anew at ``file_tokens`` ids, so that memory is bounded
by a file (and a document) at any part size.  Each is written under a temporary name and
then renamed, so a lost task leaves no half file.  Defined results: null and empty texts are the end id
alone; null keys come first; repeated keys stand next to each other, ordered by text;
an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import _order, _store, _text
from leafmill.llm.tokens import Encoder

MAGIC = b"DACTOK1\n"
RANK_STEP = 512
FILE_TOKENS = 1 << 25


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, continuation bits, rank directory)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        on = rest > 0xFF
        if not on.any():  # the last level needs no bits
            return [*levels, ((rest & 0xFF).astype(np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))]
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(on, np.arange(0, len(on), RANK_STEP), dtype=np.int64))[:-1]])
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(on, bitorder="little"), ranks.astype("<u4")))
        rest = rest[on] >> np.uint32(8)


def file_bytes(keys: np.ndarray, null_keys: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode(ids)
    sections = [("keys", keys.astype("<i8")), ("null_keys", null_keys.astype(np.uint8)), ("starts", starts.astype("<i8"))]
    sections += [(f"{name}{k}", part) for k, level in enumerate(levels) for name, part in zip(("chunks", "bits", "ranks"), level)]
    at, places, body = 0, {}, []
    for name, part in sections:
        raw = part.tobytes()
        places[name] = [at, len(raw)]
        pad = -len(raw) % 8
        body.append(raw + b"\0" * pad)
        at += len(raw) + pad
    header = json.dumps({"tokens": len(ids), "documents": len(keys), "levels": len(levels), "sections": places}).encode()
    header += b" " * (-(len(MAGIC) + 4 + len(header)) % 8)
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *body])


class Reader:
    """Random access to the tokens of one file, given as bytes or a memory map."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", raw[len(MAGIC) : len(MAGIC) + 4])
        base = len(MAGIC) + 4
        header = json.loads(bytes(raw[base : base + size]))
        base += size
        part = lambda name, kind: np.frombuffer(raw, kind, offset=base + header["sections"][name][0], count=header["sections"][name][1] // np.dtype(kind).itemsize)
        self.n_tokens, self.n_documents = header["tokens"], header["documents"]
        self.keys, self.null_keys, self.starts = part("keys", "<i8"), part("null_keys", np.uint8).astype(bool), part("starts", "<i8")
        self.levels = [(part(f"chunks{k}", np.uint8), part(f"bits{k}", np.uint8), part(f"ranks{k}", "<u4")) for k in range(header["levels"])]

    def rank(self, level: int, at: int) -> int:
        """Set bits before position ``at``."""
        chunks, bits, ranks = self.levels[level]
        if at >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        step = at // RANK_STEP
        own = np.unpackbits(bits[step * RANK_STEP // 8 : at // 8 + 1], bitorder="little")[: at - step * RANK_STEP]
        return int(ranks[step]) + int(own.sum())

    def tokens(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """Ids ``start`` to ``stop``; from level 1 on, the rest of those that stand there."""
        chunks, bits, _ = self.levels[level]
        out = chunks[start:stop].astype(np.uint32)
        if level + 1 < len(self.levels) and stop > start:
            on = np.unpackbits(bits[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            if on.any():
                first = self.rank(level, start)
                out[on] |= self.tokens(first, first + int(on.sum()), level + 1) << np.uint32(8)
        return out

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])


def write(docs: DataFrame, folder: str, *, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, file_tokens: int = FILE_TOKENS) -> list[tuple[str, int]]:
    """Write the files and return their paths with the ids before each, in key order (one entry for each file)."""
    ordered, _ = _order.in_order(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        keys, nulls, parts, sizes = [], [], [], []
        number = made = held = 0

        def saved() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            done = len(starts) - 1  # the keys after it have no ids yet
            key_row, null_row = np.concatenate(keys), np.concatenate(nulls)
            path = f"{folder}/part-{number:06d}-{made:06d}.dac"
            fs, at = _store.filesystem(path)
            _store.put_file(fs, at, file_bytes(key_row[:done], null_row[:done], starts, np.concatenate(parts)))
            keys[:], nulls[:] = [key_row[done:]], [null_row[done:]]
            parts.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([made], pa.int32()), pa.array([path]), pa.array([int(starts[-1])], pa.int64())], names=["part", "file", "path", "tokens"])

        for batch in batches:
            for part in _text.slices(batch, "text"):
                number = part.column("part")[0].as_py()
                keys.append(part.column("key").fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(np.asarray(part.column("key").is_null()))
                for ids, pointers in encoder.encode(part.column("text")):
                    parts.append(np.insert(ids, pointers[1:], end_id).astype(np.uint16 if ids.max(initial=end_id) < 1 << 16 else np.uint32))
                    sizes.append(np.diff(pointers) + 1)
                    held += len(parts[-1])
                    if held >= file_tokens:
                        yield saved()
                        made, held = made + 1, 0
        if sizes:
            yield saved()

    listed = sorted((r.part, r.file, r.path, r.tokens) for r in ordered.mapInArrow(run, "part int, file int, path string, tokens bigint").collect())
    before = accumulate((m[3] for m in listed), initial=0)
    return [(path, start) for (_, _, path, _), start in zip(listed, before)]


def read(spark: SparkSession, files: list[tuple[str, int]], *, key: str = "doc_id") -> DataFrame:
    """One row per document of the files: key, ``start`` (ids before it in all files), ``n_tokens`` and ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                fs, at = _store.filesystem(path)
                with fs.open_input_file(at) as source:
                    reader = Reader(source.read())
                sums, step = [], 1024
                for d in range(0, reader.n_documents, step):
                    bounds = reader.starts[d : d + step + 1]
                    ids = reader.tokens(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    cut = (bounds - bounds[0]).tolist()
                    sums += [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.keys, pa.int64(), mask=reader.null_keys), pa.array(reader.starts[:-1] + before, pa.int64()), pa.array(np.diff(reader.starts), pa.int64()), pa.array(sums, pa.int64())],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    listed = spark.createDataFrame(files, "path string, before bigint")
    spread = listed.repartition(max(1, len(files))) if files else listed
    return spread.mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
