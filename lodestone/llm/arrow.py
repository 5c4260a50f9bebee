"""Slices of Arrow batches, so that a task holds a few megabytes of text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` where its string or binary ``column`` exceeds ``most`` bytes; a longer value is a slice of its own."""
    if not batch.num_rows:
        return
    value = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(value), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the lengths of the lists."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
