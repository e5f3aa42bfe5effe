"""Cutting Arrow batches so that a worker's memory doesn't depend on its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and ``size`` bytes of a text column.

    A row that is larger by itself is a part of its own.  No row is lost.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)
