"""Rows of Arrow batches, a few at a time, so that what a task holds as Python objects doesn't follow Spark's batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that are Python objects at once, and bytes of them as Arrow has them (a longer row comes alone).
ROWS, BYTES = 256, 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ROWS rows and BYTES bytes, halved until they fit."""
    todo = [batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > BYTES:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows as tuples."""
    for batch in batches:
        for part in slices(batch):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)
