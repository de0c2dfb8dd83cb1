"""Rows that Python makes one by one, as Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: A batch is closed at so many rows, or at so many bytes of texts and contents.
ROWS, BYTES = 256, 1 << 20


def gathered(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order; what a row lacks is null.  Sending a batch costs as much as many small rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes | str))
        if len(held) == ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
