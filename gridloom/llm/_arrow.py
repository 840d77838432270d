"""Arrow batches in and out of Python workers with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows and bytes of text that one output batch gathers before it is sent on.
MOST_ROWS, MOST_BYTES = 1000, 4 << 20


def per_text(batches: Iterator[pa.RecordBatch], schema: pa.Schema, use: Callable[[bytes | None], tuple], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows ``(*other columns, *use(text bytes))`` for each row; other columns keep their order and come first in ``schema``."""
    for batch in batches:
        at, n = 0, batch.num_rows
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != text]
        while at < n:
            rows, size, end = [], 0, at
            while end < n and len(rows) < MOST_ROWS and size < MOST_BYTES:
                value = texts[end].as_py()
                rows.append(use(value))
                size += len(value or b"")
                end += 1
            made = [pa.array(list(c), type=schema.field(len(rest) + k).type) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at).cast(schema.field(k).type) for k, c in enumerate(rest)), *made], schema=schema)
            at = end
